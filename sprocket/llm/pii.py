"""Personal data by base patterns and a semi-Markov conditional random field (operator 4).

The base patterns of `base_spans` are found exactly, in time linear in the text. What
they leave is searched by the random field: around every digit, ``@`` or written-out
"at" that no base span covers, a window of tokens is segmented. The words beside an "at",
with all that points, hyphens and written-out dots join to them, are one token each, however
many they are, so an address is never cut. Every span of at most MAX_TOKENS tokens with such a
trigger in it is a candidate segment, scored as a whole (digits, separators, group
lengths, checksum, shape, cue word before it) and by the label before it, and
bounded-entity dynamic programming picks boundaries and kinds together. Base spans are
fixed and are never changed or overlapped. Weights are fitted by conditional likelihood
(forward-backward over segments) on labelled sentences made by `examples` from a fixed
seed; no corpus text is used.

Defined cases: null and empty text have no spans; repeated rows each get theirs; an
empty table gives an empty result; other columns pass through (the five output names
replace columns of the same name).
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order of ties, and the base patterns' parts.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

MAX_TOKENS = 15
#: Tokens before a trigger that a window takes in: the longest segment that ends with it, and two for its cue. After it come MAX_TOKENS, one more than a segment has.
BEFORE = MAX_TOKENS + 1


#: Each digit doubled, the digits of the result added up.
DOUBLED = bytes.maketrans(b"0123456789", bytes(48 + sum(map(int, str(2 * d))) for d in range(10)))


def luhn(digits: str) -> bool:
    back = digits.encode()[::-1]
    return (sum(back[::2]) + sum(back[1::2].translate(DOUBLED)) - 48 * len(back)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            free = m.end()
        # a run that starts after this @ cannot reach back over it
        free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the random field

TRIGGER = re.compile(r"[0-9@]|[(\[](?i:at)[)\]]")
TOKEN = re.compile(r"\((?i:at|dot)\)|\[(?i:at|dot)\]|[0-9]+|[^\W\d_]+|[^\s\w]|_")
CUES = ({"email", "mail", "contact", "e"}, {"ip", "host", "server", "address"}, {"card", "visa", "mastercard", "amex"}, {"tel", "phone", "call", "fax", "mobile", "telefon", "tél", "teléfono"})
AT = r"(?:@|\s*[(\[](?i:at)[)\]]\s*)"
DOT = r"(?:\.|\s*[(\[](?i:dot)[)\]]\s*)"
EMAILISH = re.compile(rf"[\w.%+-]+(?:{DOT}[\w.%+-]+)*{AT}[\w-]+(?:{DOT}[\w-]+)*{DOT}[^\W\d_]{{2,63}}")
IPISH = re.compile(r"[0-9]{1,3}(?:(?:\.|\s*[(\[](?i:dot)[)\]]\s*)[0-9]{1,3}){3}")
NUMBERS = re.compile(r"[+(]?[0-9](?:[\s().·/_–-]*[0-9])*")
AT_SIGN = re.compile(r"@|[(\[](?i:at)[)\]]")
DOT_WORD = re.compile(r"[(\[](?i:dot)[)\]]")
LETTER = re.compile(r"[^\W\d_]")
JOINED = re.compile(r"[\w.%+@ ()\[\]·/–-]+")
#: What joins the words on either side of an "at", and the groups of a number.
IN_NAME, IN_NUMBER = frozenset("._%+-"), frozenset("().·/_–-")
#: Blanks within a number, and between the words of no address.
GAP = 3
N_FEATURES = 28
#: Labels of the field: the kinds, and a token outside all of them.
OUT = len(KINDS)


def _digit_class(n: int) -> int:
    return 1 if n == 0 else 2 if n < 7 else 3 if n < 9 else 4 if n < 12 else 5 if n < 16 else 6 if n < 20 else 7


def features(s: str, before: str) -> list[int]:
    """Indices of the features that hold for the whole span s after the word before it."""
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups]
    n = sum(sizes)
    out = [0, _digit_class(n)]
    if EMAILISH.fullmatch(s):
        out.append(8)
    out += _number(s, groups, NUMBERS.fullmatch(s) is not None, before)
    if 11 not in out and n and n < len(re.sub(r"\W", "", DOT_WORD.sub("", s))):
        out.append(19)  # digits among letters
    if not AT_SIGN.search(s) and LETTER.search(DOT_WORD.sub("", s)):
        out.append(24)  # words, and nothing that makes an address of them
    return out + _cues(before)


def _number(s: str, groups: list[str], whole: bool, before: str) -> list[int]:
    """The features of a span of groups of digits; whole: nothing but a number's signs are between them."""
    sizes = tuple(map(len, groups))
    n = sum(sizes)
    out = []
    if len(sizes) == 4 and n <= 12 and IPISH.fullmatch(s):
        out.append(9 if all(int(g) <= 255 for g in groups) else 10)
    if whole:
        out += _shape(sizes, s[0] in "+(" or "(" in s, before in CUES[3])
        if 12 <= n <= 19:
            out.append(26 if not luhn("".join(groups)) else 12 if len(sizes) > 1 else 13)
    return out


@functools.lru_cache(maxsize=1 << 16)
def _shape(sizes: tuple[int, ...], opened: bool, said: bool) -> tuple[int, ...]:
    """The features of a number that follow from the sizes of its groups."""
    n = sum(sizes)
    out = [11]
    if len(sizes) >= 3 and 2 <= sizes[-1] <= 4 and all(2 <= x <= 4 for x in sizes[1:]):
        out.append(14)
    if sizes == (4, 4, 4, 4):
        out.append(15)
    if sizes == (4, 2, 2):
        out.append(16)  # a date
    if opened:
        out.append(17)
    if len(sizes) == 1:
        out.append(18)
    if sizes == (3, 3, 4):
        out.append(25)
    if 7 <= n <= 15 and said:
        out.append(27)
    return tuple(out)


def _cues(before: str) -> list[int]:
    return [20 + i for i, cue in enumerate(CUES) if before in cue]


def tokens(text: str, left: int = 0, right: int | None = None) -> list[tuple[int, int]]:
    """Words, numbers and signs of a stretch; what is joined to either side of an "at" is one token there."""
    right = len(text) if right is None else right
    raw = [m.span() for m in TOKEN.finditer(text, left, right)]
    ats = [k for k, (a, b) in enumerate(raw) if (b - a == 1 or b - a == 4) and AT_SIGN.match(text, a)]
    if not ats:
        return raw
    word = lambda k: text[raw[k][0]].isalnum()
    inner = lambda k: word(k) or text[raw[k][0]] in IN_NAME
    dot = lambda k: DOT_WORD.match(text, raw[k][0]) is not None
    near = lambda k: text[raw[k - 1][1] : raw[k][0]].strip(" ") == ""
    glued = bytearray(len(raw))  # whether a token goes on from the one before it
    done = 0
    for at in ats:
        written_out = text[raw[at][0]] != "@"
        # back from the "at": words and signs without blanks, and written-out dots with or without
        k = at - 1
        if k >= done and word(k) and (raw[k][1] == raw[at][0] or (written_out and near(at))):
            first = k
            while k > done and ((raw[k - 1][1] == raw[k][0] and inner(k - 1)) or (near(k) and (dot(k - 1) or (dot(k) and inner(k - 1))))):
                k -= 1
                if word(k):
                    first = k
            glued[first + 1 : at] = b"\1" * (at - first - 1)
        done = at + 1
        k = at + 1
        if k < len(raw) and word(k) and (raw[k][0] == raw[at][1] or (written_out and near(k))):
            last = k
            while k + 1 < len(raw) and ((raw[k + 1][0] == raw[k][1] and inner(k + 1)) or (near(k + 1) and (dot(k + 1) or (dot(k) and inner(k + 1))))):
                k += 1
                if word(k):
                    last = k
            glued[at + 2 : last + 1] = b"\1" * (last - at - 1)
            done = last + 1
    out: list[tuple[int, int]] = []
    for (a, b), on in zip(raw, glued, strict=True):
        if on:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of whole tokens around triggers outside the taken spans, merged where they overlap; none crosses a taken span or the end of a line. Each holds all segments that its triggers can be part of."""
    ends = [0, *(e for _, e in taken)]
    for left, right in zip(ends, [*(s for s, _ in taken), len(text)], strict=True):
        if not TRIGGER.search(text, left, right):
            continue
        lo = hi = -1
        rest, starts = 0, deque(maxlen=BEFORE + 1)
        line = text.find("\n", left, right)
        for a, b in tokens(text, left, right):
            if 0 <= line < a:
                if hi > lo:
                    yield lo, hi
                lo = hi = -1
                rest = 0
                starts.clear()
                line = text.find("\n", a, right)
            starts.append(a)
            if TRIGGER.match(text, a) or (b - a > 1 and TRIGGER.search(text, a, b)):
                if starts[0] > hi:
                    if hi > lo:
                        yield lo, hi
                    lo = starts[0]
                hi, rest = b, MAX_TOKENS
            elif rest:
                hi, rest = b, rest - 1
        if hi > lo:
            yield lo, hi


#: What a token is: a group of digits, an "at", a word, another sign.
GROUP, AT_WORD, WORD, SIGN = range(4)
#: Digits that a span has at least, unless it has an "at" or four groups: fewer make no number of any kind.
LEAST_DIGITS = 7


class Window:
    """The tokens of a stretch of text, and the candidate segments that begin at each."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = tokens(text)
        words = self.words = [text[a:b] for a, b in self.tokens]
        n = len(words)
        self.kind = [GROUP if w.isdecimal() else AT_WORD if AT_SIGN.fullmatch(w) else WORD if w[0].isalnum() else SIGN for w in words]
        name = [k == AT_WORD or (k == SIGN and len(w) > 1 and DOT_WORD.fullmatch(w) is not None) for k, w in zip(self.kind, words, strict=True)]
        gaps = ["", *(text[a:b] for (_, a), (b, _) in zip(self.tokens, self.tokens[1:], strict=False))][:n]
        #: whether a span may go on to a token from the one before it
        self.joined = [JOINED.fullmatch(w) is not None and not g.strip(" ") and (len(g) <= GAP or name[k] or name[k - 1]) for k, (w, g) in enumerate(zip(words, gaps, strict=True))]
        self.begins = [(k in (GROUP, WORD) or w in "+(") and JOINED.fullmatch(w) is not None for k, w in zip(self.kind, words, strict=True)]
        self.close = [not g for g in gaps]
        #: whether a token and the one before it are parts of one name or word: a span that ends between them would cut it
        self.goes_on = [False] * (n + 1)
        for k in range(1, n):
            signs = [w for w, sign in ((words[k - 1], name[k - 1]), (words[k], name[k])) if sign]
            self.goes_on[k] = (words[k - 1][-1].isalnum() and words[k][0].isalnum() and not gaps[k]) or any(w != "@" or not gaps[k] for w in signs)

    def segments(self, i: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(one past the last token, features) of every span of at most MAX_TOKENS tokens from i on with a trigger in it that begins and ends with whole words, numbers or names and holds no sign that joins nothing."""
        words, kind, joined, goes_on = self.words, self.kind, self.joined, self.goes_on
        if not self.begins[i] or goes_on[i]:
            return
        before = words[i - 2].lower() if i > 1 and words[i - 1] == ":" else words[i - 1].lower() if i else ""
        cues = tuple(_cues(before))
        begin = self.tokens[i][0]
        has_at = has_word = scored = False
        # a number goes on while only its signs are between its groups; the first may follow a plus or a bracket at once
        number, groups, n = True, [], 0
        for j in range(i, min(len(words), i + MAX_TOKENS)):
            if j > i and not joined[j]:
                break
            w, k = words[j], kind[j]
            if k == GROUP:
                groups.append(w)
                n += len(w)
                if len(groups) == 1 and j > i and not (j == i + 1 and self.close[j] and kind[i] == SIGN):
                    number = False
            elif k == AT_WORD:
                has_at, number = True, False
            elif k == WORD:
                has_word, number = True, False
                n += len(DIGIT.findall(w))
            else:
                number = number and (w in IN_NUMBER if groups else j == i)
                scored = scored or w == "_"
                continue
            if goes_on[j + 1] or k == AT_WORD:
                continue
            if has_at:
                yield j + 1, tuple(features(self.text[begin : self.tokens[j][1]], before))
            elif n < LEAST_DIGITS and len(groups) != 4:
                continue
            elif has_word:
                # words without an at sign: no shape can hold
                yield j + 1, (0, _digit_class(n), *((19,) if n else ()), 24, *cues)
            else:
                yield j + 1, (0, _digit_class(n), *_number(self.text[begin : self.tokens[j][1]], groups, number, before), *((19,) if scored and not number else ()), *cues)


def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Tokens of a window, and all its candidate segments (first token, one past the last, features)."""
    x = Window(text)
    return x.tokens, [(i, j, list(f)) for i in range(len(x.tokens)) for j, f in x.segments(i)]


@dataclass
class Weights:
    """Of spans (kind, feature), and of a label after another (label, label); one outside after another outside weighs 0."""

    span: np.ndarray
    step: np.ndarray


def scores(segs: list, weights: Weights) -> np.ndarray:
    """(segment, kind)"""
    return np.array([weights.span[:, f].sum(axis=1) for _, _, f in segs]).reshape(len(segs), len(KINDS))


def _by(segs: list, side: int) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for k, seg in enumerate(segs):
        out.setdefault(seg[side], []).append(k)
    return {at: np.array(ks) for at, ks in out.items()}


def decode(text: str, weights: Weights) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best labelling's segments; a tie goes to what is outside. Only a few numbers a token are held, so a window may be long."""
    x = Window(text)
    n, step = len(x.tokens), weights.step.tolist()
    # the most that a label can gain over "outside" by the steps into and out of it
    gain = (weights.step[:, :OUT] - weights.step[:, OUT:]).max(axis=0) + np.maximum(0, (weights.step[:OUT] - weights.step[OUT]).max(axis=1))
    #: by features, the labels that can be better than outside, whatever is around them
    known: dict[tuple[int, ...], list[tuple[int, float]]] = {}
    labels = range(OUT + 1)
    best = [[-math.inf] * (OUT + 1) for _ in range(n + 1)]
    best[0][OUT] = 0.0
    first, last = np.full((n + 1, OUT + 1), -1, np.int32), np.zeros((n + 1, OUT + 1), np.int8)
    for i in range(n):
        here = best[i]
        reached = [y for y in labels if here[y] > -math.inf]
        top = max(reached, key=lambda y: (here[y] + step[y][OUT], y == OUT))
        best[i + 1][OUT], first[i + 1, OUT], last[i + 1, OUT] = here[top] + step[top][OUT], i, top
        into: dict[int, tuple[float, int]] = {}
        for j, f in x.segments(i):
            if f not in known:
                score = weights.span[:, list(f)].sum(axis=1)
                known[f] = [(y, float(score[y])) for y in range(OUT) if score[y] + gain[y] > 0]
            for y, score in known[f]:
                if y not in into:
                    into[y] = max((here[z] + step[z][y], -z) for z in reached)
                got = into[y][0] + score
                if got > best[j][y]:
                    best[j][y], first[j, y], last[j, y] = got, i, -into[y][1]
        best[i] = []
    y = max(labels, key=lambda y: (best[n][y], y == OUT))
    out, j = [], n
    while j:
        i = int(first[j, y])
        if y < OUT:
            out.append((x.tokens[i][0], y, x.tokens[j - 1][1]))
        j, y = i, int(last[j, y])
    return out[::-1]


def sums(n: int, segs: list, weights: Weights) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all labellings of n tokens: the log of the sum of their weights, and the expected numbers of each (segment, kind) and of each step."""
    sc, ends, begins, step = scores(segs, weights), _by(segs, 1), _by(segs, 0), weights.step
    fwd, bwd = np.full((n + 1, OUT + 1), -np.inf), np.full((n + 1, OUT + 1), -np.inf)
    fwd[0, OUT] = 0.0
    bwd[n] = 0.0
    first, last = np.array([s[0] for s in segs], int), np.array([s[1] for s in segs], int)
    for j in range(1, n + 1):
        fwd[j, OUT] = np.logaddexp.reduce(fwd[j - 1] + step[:, OUT])
        if j in ends:
            ks = ends[j]
            fwd[j, :OUT] = np.logaddexp.reduce(fwd[first[ks]][:, :, None] + step[None, :, :OUT] + sc[ks][:, None, :], axis=(0, 1))
    for i in range(n - 1, -1, -1):
        x = (step[:, OUT] + bwd[i + 1, OUT])[:, None]
        if i in begins:
            ks = begins[i]
            x = np.concatenate((x, (step[None, :, :OUT] + (sc[ks] + bwd[last[ks], :OUT])[:, None, :]).transpose(1, 0, 2).reshape(OUT + 1, -1)), axis=1)
        bwd[i] = np.logaddexp.reduce(x, axis=1)
    total = np.logaddexp.reduce(fwd[n])
    each = np.exp(fwd[first][:, :, None] + step[None, :, :OUT] + (sc + bwd[last, :OUT])[:, None, :] - total) if segs else np.zeros((0, OUT + 1, OUT))
    steps = np.zeros((OUT + 1, OUT + 1))
    steps[:, :OUT] = each.sum(axis=0)
    steps[:, OUT] = np.exp(fwd[:-1] + step[None, :, OUT] + bwd[1:, OUT][:, None] - total).sum(axis=0)
    return float(total), each.sum(axis=1), steps


def examples(seed: int = 20, n: int = 300) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with labelled spans: each kind in forms that the base patterns miss, and look-alikes without a label."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice(["en", "ta", "ri", "mo", "le", "su", "ka", "ver"]) for _ in range(r.randint(1, 3)))

    def card(sep: str) -> str:
        body = r.choice("3456") + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def one() -> tuple[str, int]:
        k = r.randrange(18)
        if k == 0:
            return f"{w()}.{w()} (at) {w()} (dot) {r.choice(['com', 'org', 'de'])}", 0
        if k == 1:
            return f"{w()}[at]{w()}[dot]{r.choice(['com', 'net'])}", 0
        if k == 2:
            return " (dot) ".join(str(r.randrange(256)) for _ in range(4)), 1
        if k == 3:
            return card(r.choice([".", "/", "_", " - "])), 2
        if k == 4:
            return f"({d(3)}) {d(3)}-{d(4)}", 3
        if k == 5:
            return f"{d(3)}-{d(3)}-{d(4)}", 3
        if k == 6:
            return f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", -1
        if k == 7:
            return f"{d(1)}.{d(1)}", -1
        if k == 8:
            return d(r.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 20, 24])), -1
        if k == 9:
            return f"{d(3)}.{d(3)}.{d(3)}", -1
        if k == 10:
            return f"{d(2)}:{d(2)}", -1
        if k == 11:
            return f"{d(2)}{w()}{d(3)}{w()}", -1
        if k == 12:
            return " ".join(d(r.randint(1, 3)) for _ in range(r.randint(2, 6))), -1
        if k == 13:
            return f"{300 + r.randrange(600)}.{d(3)}.{d(2)}.{d(3)}", -1
        if k == 14:  # like a card, but for its checksum
            body = r.choice("3456") + d(14)
            full = body + next(c for c in r.sample("0123456789", 10) if not luhn(body + c))
            sep = r.choice([".", "/", "_", " - "])
            return sep.join(full[i : i + 4] for i in range(0, 16, 4)), -1
        if k == 15:
            return f"{w()}-{w()}.{w()} ({r.choice(['at', 'At', 'AT'])}) {w()}-{w()} ({r.choice(['dot', 'Dot'])}) {r.choice(['co', 'ac'])} (dot) {r.choice(['uk', 'photography'])}", 0
        # numbers of a telephone's length, which are one behind a word that says so
        return r.choice([d(10), d(11), f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"0{d(3)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]), 4

    out = []
    for _ in range(n):
        text, spans = " ".join(w() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(1, 2)):
            s, y = one()
            y, said = (3, 1.0) if y == 4 and r.random() < 0.5 else (-1, 0.0) if y == 4 else (y, 0.3)
            if y >= 0 and r.random() < said:
                text += " " + r.choice(sorted(CUES[y])) + r.choice(["", ":"])
            if y >= 0:
                spans.append((len(text) + 1, y, len(text) + 1 + len(s)))
            text += f" {s}{r.choice(['', ',', '.'])} " + " ".join(w() for _ in range(r.randint(2, 4)))
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def trained(epochs: int = 10, rate: float = 0.5, decay: float = 0.002) -> Weights:
    """Weights by AdaGrad on the conditional log-likelihood."""
    data = []
    for text, spans in examples():
        tokens, segs = lattice(text)
        kind = {(s, e): y for s, y, e in spans}
        gold = [(k, kind[tokens[i][0], tokens[j - 1][1]]) for k, (i, j, _) in enumerate(segs) if (tokens[i][0], tokens[j - 1][1]) in kind]
        x = np.zeros((len(segs), N_FEATURES))
        for k, (_, _, f) in enumerate(segs):
            x[k, f] = 1
        seen, steps, at, last = np.zeros((len(segs), OUT)), np.zeros((OUT + 1, OUT + 1)), 0, OUT
        for k, y in sorted(gold, key=lambda g: segs[g[0]][0]):
            seen[k, y] = 1
            for _ in range(at, segs[k][0]):
                steps[last, OUT] += 1
                last = OUT
            steps[last, y] += 1
            at, last = segs[k][1], y
        for _ in range(at, len(tokens)):
            steps[last, OUT] += 1
            last = OUT
        data.append((len(tokens), segs, x, seen, steps))
    w = Weights(np.zeros((OUT, N_FEATURES)), np.zeros((OUT + 1, OUT + 1)))
    past = Weights(np.full_like(w.span, 1e-6), np.full_like(w.step, 1e-6))
    for _ in range(epochs):
        for n, segs, x, seen, steps in data:
            if not segs:
                continue
            _, expect, expect_steps = sums(n, segs, w)
            grad, step = (seen - expect).T @ x - decay * w.span, steps - expect_steps - decay * w.step
            step[OUT, OUT] = 0.0
            past.span += grad**2
            past.step += step**2
            w.span += rate * grad / np.sqrt(past.span)
            w.step += rate * step / np.sqrt(past.step)
    return w


def all_spans(text: str, weights: Weights, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    base = base_spans(text) if base is None else base
    if not TRIGGER.search(text):
        return base
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    more = [(a + s, y, a + e) for a, b in windows(text, taken) for s, y, e in decode(text[a:b], weights)]
    return sorted(base + more) if more else base


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _apply(df: DataFrame, text: str, fields: list[tuple[str, T.DataType, pa.DataType]], of, keep: list[str]) -> DataFrame:
    """keep, and the fields that of(text) gives for each row, in Arrow batches."""
    weights = trained()
    own = [f for f in df.select(*keep).schema.fields if f.name not in {n for n, _, _ in fields}]
    names = [f.name for f in own]
    out = T.StructType([*own, *(T.StructField(n, t) for n, t, _ in fields)])
    src = df.select(*names, F.col(text).alias("_pii_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(t or "", weights) for t in b.column(len(names)).to_pylist()]
            cols = [pa.array([r[k] for r in rows], type=t) for k, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *cols], names=[*names, *(n for n, _, _ in fields)])

    return src.mapInArrow(run, out)


def _digest(text: str, weights: Weights) -> tuple:
    base = base_spans(text)
    counts = [0, 0, 0, 0]
    for _, k, _ in base:
        counts[k] += 1
    return (*counts, hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(all_spans(text, weights, base)))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns but the text) with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them."""
    fields = [*((f"n_{k}", T.LongType(), pa.int64()) for k in KINDS), ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string())]
    return _apply(df, text, fields, _digest, keep if keep is not None else [c for c in df.columns if c != text])


def _redacted(text: str, weights: Weights) -> tuple[str]:
    out, at = [], 0
    for s, k, e in all_spans(text, weights):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return ("".join([*out, text[at:]]),)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span in its text replaced by its kind in angle brackets; a null text stays null."""
    marked = df.withColumn("_pii_null", F.col(text).isNull())
    clean = _apply(marked, text, [("_pii_clean", T.StringType(), pa.string())], _redacted, [c for c in marked.columns if c != text])
    return clean.select(*(F.when(F.col("_pii_null"), F.lit(None).cast("string")).otherwise(F.col("_pii_clean")).alias(c) if c == text else F.col(c) for c in df.columns))
