"""Documents in YAML and edits in their text."""

import json
import random

import pytest

from oracle import SF, same
from sprocket.operators import patches
from sprocket.operators.patches import patched
from sprocket.plans import queries as Q
from sprocket.plans import yamls  # noqa: F401
from sprocket.sources import documents, yaml_text
from sprocket.sources.yaml_text import read

yaml = pytest.importorskip("yaml")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("a: 1\nb: [x, 'y', \"z\"]", {"a": 1, "b": ["x", "y", "z"]}),
        ("a: yes\nb: no\nc: on\nd: true\ne: FALSE", {"a": "yes", "b": "no", "c": "on", "d": True, "e": False}),
        ("a: 010\nb: 0o10\nc: 0x1F\nd: -3\ne: +4\nf: 1_000", {"a": 10, "b": 8, "c": 31, "d": -3, "e": 4, "f": "1_000"}),
        ("a: 1.5\nb: .5\nc: 1e3\nd: 1.\ne: '1.5'", {"a": 1.5, "b": 0.5, "c": 1000.0, "d": 1.0, "e": "1.5"}),
        ("a: ~\nb:\nc: null\nd: ''", {"a": None, "b": None, "c": None, "d": ""}),
        ("a: 2024-01-05\nb: '2024-01-05'\nc: !!str 2024-01-05", {"a": {"date": "2024-01-05"}, "b": "2024-01-05", "c": "2024-01-05"}),
        ("look:\n  since: 2024-01-05\nmetadata: {date: 2024-1-5}", {"look": {"since": "2024-01-05"}, "metadata": {"date": "2024-01-05"}}),
        ("a: &x {p: 1, q: 2}\nb:\n  <<: *x\n  q: 3\nc: *x", {"a": {"p": 1, "q": 2}, "b": {"q": 3, "p": 1}, "c": {"p": 1, "q": 2}}),
        ("a: |\n  one\n  two\nb: >\n  one\n  two\n", {"a": "one\ntwo\n", "b": "one two\n"}),
        ("{1: a, '1': b, true: c}", {"1": "b", "true": "c"}),
        ("a: .inf", {"a": {"number": "inf"}}),
    ],
)
def test_values(text, value):
    got = read(text.encode())
    assert got["problem"] is None and json.loads(got["json"]) == value


@pytest.mark.parametrize(
    ("text", "problem", "line", "column"),
    [
        (None, "absent", None, None),
        (b"", "empty", None, None),
        (b"# only a comment\n", "empty", None, None),
        (b"~\n", "empty", None, None),
        (b"\xff\xfe", "not UTF-8", None, None),
        (b"a: 1\na: 2\n", "duplicate key", 2, 1),
        (b"a:\n  b: 1\n  c: 2\n  b: 3\n", "duplicate key", 4, 3),
        (b"date: 2024-02-30\n", "invalid value", 1, 7),
        (b"a: !!int x\n", "invalid value", 1, 4),
        (b"a: [1\nb: 2\n", "malformed", 2, 2),
        (b"\ta: 1\n", "malformed", 1, 1),
        (b"a: *b\n", "malformed", 1, 4),
        (b"a: 1\n---\nb: 2\n", "several documents", 2, 1),
        (b"? [a]\n: 1\n", "key is a collection", 1, 3),
        (b"[" * 300 + b"]" * 300, "nested too deeply", 1, 202),
        (b'a: "\\ud800"\n', "lone surrogate", None, None),
        (b"a: &a [x,x,x,x,x,x,x,x,x]\n" + b"".join(b"%c: &%c [%s]\n" % (98 + i, 98 + i, b",".join([b"*%c" % (97 + i)] * 9)) for i in range(8)), "too large", None, None),
    ],
)
def test_refusals_with_positions(text, problem, line, column):
    got = read(text)
    assert got["problem"] == problem and got["json"] is None
    if line:
        assert (got["line"], got["column"]) == (line, column)


def test_keys_that_are_no_text():
    got = read(b"look:\n  2024-01-01: x\n  nested: {1: a, ok: b, ~: c}\n2.5: y\n")
    assert [(k["path"], k["kind"], k["line"]) for k in got["odd_keys"]] == [("look.2024-01-01", "date", 2), ("look.nested.1", "integer", 3), ("look.nested.null", "null", 3), ("2.5", "number", 4)]


def test_documents_obey_the_strict_rules(spark):
    rows = [
        ("good", "version: 0\nmetadata: {title: Lake, date: 2024-05-01}\nchapters:\n- name: ''\n  clips: [a.mp4]\nclips:\n  a.mp4: {trims: [{in: 0, out: 2.5}], rotate: 90}\n"),
        ("false", "version: false\n"),
        ("zero", "version: 0.0\n"),
        ("list", "- 1\n"),
        ("title", "version: 0\nmetadata: {title: 2024-01-01}\n"),
        ("look", "version: 0\nlook: {1: a}\n"),
        ("twice", "version: 0\nchapters:\n- {name: a, clips: [x, x]}\n"),
        ("tab", "version: 0\n\tlook: a\n"),
    ]
    d = yaml_text.read_documents(spark.createDataFrame(rows, "event string, text string"), "text")
    got = {r["event"]: (r["problem"], r["line"]) for r in d.collect()}
    assert got["tab"][0] == "malformed" and got.pop("tab")[1]
    assert got == {"good": (None, None), "false": ("unsupported version", None), "zero": ("unsupported version", None), "list": ("not a mapping", None), "title": ("metadata.title", None), "look": ("look key", 2), "twice": ("duplicate clip", None)}
    assert documents.references(d, "event").collect()[0]["clip"] == "a.mp4"
    s = yaml_text.project_settings(spark.createDataFrame([("a", "layout: flat\nsort: {reverse: true}\n"), ("b", ""), ("c", "sort: [1]"), ("d", "layout: 'x"), ("e", None)], "p string, text string"), "text")
    assert {r["p"]: (r["problem"], r["settings"] and r["settings"]["layout"]) for r in s.collect()} == {"a": (None, "flat"), "b": (None, None), "c": ("sort", None), "d": ("malformed", None), "e": (None, None)}


DOC = """# head

version: 0   # format
metadata:
    title: 'Lake'  # quoted
    date: 2024-05-01

chapters:
  # the first
  - name: Morning
    clips:
      - a.mp4
      - b.mp4   # second

  - name: Evening
    clips: [c.mp4, 'd.mp4']   # flow
clips:
  a.mp4: {rotate: 90, title: yes}
  b.mp4:
    trims:
    - in: 0
      out: 2
note: |
  kept
  as is

# tail
"""


def edits(*e):
    return [{"n": i, "op": op, "path": path.split("|"), "value": value} for i, (op, path, value) in enumerate(e, 1)]


@pytest.mark.parametrize(
    ("edit", "old", "new"),
    [
        (("set", "metadata|title", '"Sea: 2"'), "'Lake'", '"Sea: 2"'),
        (("set", "metadata|title", '"Sea"'), "'Lake'", "Sea"),
        (("set", "metadata|location", '"Pier"'), "date: 2024-05-01\n", "date: 2024-05-01\n    location: Pier\n"),
        (("append", "chapters|0|clips", '"n.mp4"'), "- b.mp4   # second\n", "- b.mp4   # second\n      - n.mp4\n"),
        (("append", "chapters|1|clips", '"n.mp4"'), "'d.mp4']", "'d.mp4', n.mp4]"),
        (("remove", "chapters|0|clips|0", None), "      - a.mp4\n", ""),
        (("remove", "chapters|1|clips|1", None), ", 'd.mp4'", ""),
        (("remove", "chapters|1|clips|0", None), "c.mp4, ", ""),
        (("remove", "metadata|title", None), "    title: 'Lake'  # quoted\n", ""),
        (("set", "clips|a.mp4|exclude", "true"), "title: yes}", "title: yes, exclude: true}"),
        (("set", "clips|a.mp4|rotate", "180"), "rotate: 90", "rotate: 180"),
        (("set", "clips|b.mp4|trims|0|out", "3.5"), "out: 2\n", "out: 3.5\n"),
        (("append", "ignore", '"x.mp4"'), "  as is\n", "  as is\nignore: [x.mp4]\n"),
        (("set", "note", '"short"'), "|\n  kept\n  as is\n", "short\n"),
        (("set", "chapters|0|name", '"Früh"'), "Morning", '"Früh"'),
    ],
)
def test_an_edit_changes_its_own_characters_only(edit, old, new):
    assert DOC.count(old) == 1
    assert patched(DOC, edits(edit)) == (DOC.replace(old, new), None, None)
    crlf = DOC.replace("\n", "\r\n")
    assert patched(crlf, edits(edit)) == (crlf.replace(old.replace("\n", "\r\n"), new.replace("\n", "\r\n")), None, None)


def test_refused_edits_leave_the_text():
    for e, problem in (
        (("remove", "metadata|place", None), "no such place"),
        (("set", "chapters|9|name", '"x"'), "no such place"),
        (("append", "metadata|title", '"x"'), None),
        (("turn", "a", None), "unknown edit"),
        (("set", "version|0", "1"), "no such place"),
    ):
        text, said, n = patched(DOC, edits(("set", "metadata|title", '"New"'), e))
        assert text == DOC and n == 2 and said and (problem is None or said in (problem, "nothing there"))
    shared = "a: &x [1]\nb: *x\n"
    assert patched(shared, edits(("append", "b", "2"))) == (shared, "cannot be placed", 1)
    assert patched("a: [1\n", edits(("set", "a", "2")))[1] == "malformed"
    assert patched("", edits(("set", "a|b", "2")))[0] == "a: {b: 2}\n"
    assert patched("a:\n", edits(("set", "a", "2")))[0] == "a: 2\n"
    assert patched("a: # none\nb: 1\n", edits(("append", "a", "2")))[1] in (None, "cannot be placed")


@pytest.mark.parametrize("seed", range(40))
def test_random_edits_say_what_they_should_and_leave_the_rest(seed):
    r = random.Random(seed)
    text = DOC
    for _ in range(6):
        paths = ["metadata|title", "metadata|date", "chapters|0|clips", "chapters|1|clips", "chapters|0|clips|0", "chapters|1", "clips|a.mp4", "clips|b.mp4|trims|0|in", "look|font", "ignore", "note", "version"]
        e = edits((r.choice(["set", "append", "remove"]), r.choice(paths), r.choice(["1", '"two words"', '"- x: y"', "null", "[1, 2]", '{"a": "#"}'])))
        new, problem, _ = patched(text, e)
        if problem:
            assert new == text
            continue
        # what is before and behind the splice is untouched
        a = next((i for i, (x, y) in enumerate(zip(text, new)) if x != y), min(len(text), len(new)))
        b = next((i for i, (x, y) in enumerate(zip(text[a:][::-1], new[a:][::-1])) if x != y), min(len(text), len(new)) - a)
        assert text[:a] == new[:a] and text[len(text) - b :] == new[len(new) - b :]
        assert patches._same(yaml_text.Reader(new).document(), patches._edited(yaml_text.Reader(text).document(), e[0]["op"], e[0]["path"], json.loads(e[0]["value"])))
        text = new


@pytest.mark.parametrize("name", ["yaml_documents", "yaml_references", "patched_documents"])
def test_against_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])
