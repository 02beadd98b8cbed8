"""The random field on sentences of another hand than the generator that trains it: written for this test, with the spans in double angle brackets."""

import random
import time

import pytest

from sprocket.llm import pii

#: kind: sentences; «» mark what is personal data, a sentence without marks has none
SENTENCES = {
    "email": """write to «mary-ann.von-der-heide (at) north-west-freight (dot) co (dot) uk» today
mail me at «k.o'neill (at) studio (dot) photography», or do not
contact: «info[at]verein-der-freunde[dot]de»
Send the form to «claims (AT) insurance (DOT) example (DOT) org» by Friday.
our desk is «helpdesk (At) campus (Dot) university (Dot) edu» and it never sleeps
schreiben Sie an «anna.b (at) post (dot) at»
écrivez à «jean-luc.petit[at]mairie[dot]fr» avant midi
reach «a.very.long.name.with.many.parts (at) a-host-with-many-parts (dot) some-where (dot) com»
«first (dot) last (at) company (dot) io» is the address
She left (at) noon and came back (at) five
look (at) this dot and that (dot) there""",
    "ip": """the old box was «192 (dot) 168 (dot) 4 (dot) 17» until May
ping «10[dot]20[dot]30[dot]40» first
host «8 (dot) 8 (dot) 4 (dot) 4» answers
version 10 (dot) 4 is out, and 10.4.1 follows
use release 300 (dot) 400 (dot) 500 (dot) 600 instead""",
    "card": """paid with «4111.1111.1111.1111» on Monday
card «5500/0000/0000/0004» was refused
visa: «4012_8888_8888_1881» expires soon
the form says «3566.0020.2036.0505», which is a test number
4111.1111.1111.1112 fails the check and is an order number
serial 1234.5678.9012.3456 is on the back
the part 5500/0000/0000/0005 is out of stock""",
    "phone": """tel «5551234567» after six
fax: «020 7946 0958»
call «(415) 555-0132» for tickets
phone «0301 234567» or write
Telefon: «040/123456» (Büro)
mobile «07700 900123» works best
«555-867-5309» was a song
ring «(020) 7946 0018» before noon
numéro de téléphone: call «06 12 34 56 78» please
order 5551234567 has been sent
on 2024-01-05 at 10:30 in room 12
between 1914 and 1918 some 17 million fell
population 8 419 316 in 2020
chapter 3.2, page 12, lines 100-117
it sold 1200 of 3500 units, up 4.5 percent
the code is 1234 5678 and nothing else
isbn 978-3-16-148410-0 is out of print
ratio 16:9, 1920x1080, 24 frames
items 1 2 3 4 5 6 7 8 9 10 11 12 follow""",
}


def labelled():
    for kind, block in SENTENCES.items():
        for line in block.split("\n"):
            spans, text = [], ""
            for k, part in enumerate(line.replace("»", "«").split("«")):
                if k % 2:
                    spans.append((len(text), pii.KINDS.index(kind), len(text) + len(part)))
                text += part
            yield text, spans


def test_recall_and_precision_on_sentences_of_another_hand():
    weights = pii.trained()
    found = right = wanted = 0
    for text, spans in labelled():
        got = set(pii.all_spans(text, weights))
        found, wanted, right = found + len(got), wanted + len(spans), right + len(got & set(spans))
    print(f"recall {right}/{wanted}, precision {right}/{found}")
    assert right >= 0.85 * wanted and right >= 0.9 * found


@pytest.mark.parametrize("text", [t for t, s in labelled() if s])
def test_no_part_of_a_found_name_is_left(text):
    """What stands beside a redacted span is no letter or digit, and no "at" or "dot"."""
    weights = pii.trained()
    for s, _, e in pii.all_spans(text, weights):
        before, after = text[:s].rstrip(" "), text[e:].lstrip(" ")
        assert not before[-5:].lower().endswith(("(at)", "[at]", "(dot)", "[dot]")) and not after[:5].lower().startswith(("(at)", "[at]", "(dot)", "[dot]"))
        assert not (text[s - 1 : s].isalnum() or text[e : e + 1].isalnum())


def test_features_of_a_number_are_those_of_its_text():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["1", "22", "4111", " ", ".", "-", "/", "_", "(", ")", "+", "a", "(dot)", " "]) for _ in range(r.randint(1, 14)))
        window = pii.Window(text)
        for i in range(len(window.tokens)):
            before = window.words[i - 1].lower() if i else ""
            for j, f in window.segments(i):
                span = text[window.tokens[i][0] : window.tokens[j - 1][1]]
                assert sorted(f) == sorted(pii.features(span, before)), span


def test_a_long_line_of_digits_takes_a_few_seconds():
    weights, r = pii.trained(), random.Random(1)
    text = " ".join(r.choice("0123456789") for _ in range(50_000))
    began = time.perf_counter()
    pii.all_spans(text, weights)
    assert time.perf_counter() - began < 15


def test_a_name_of_any_number_of_parts_is_one_span():
    weights = pii.trained()
    name = "me (at) " + " (dot) ".join(["part"] * 200) + " (dot) org"
    assert [f"see {name} now"[s:e] for s, _, e in pii.all_spans(f"see {name} now", weights)] == [name]
