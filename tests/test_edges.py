"""Null keys, long digit runs and other edges."""

import pytest
from pyspark.sql import functions as F

from sprocket.functions import scalars as S
from sprocket.operators import edits, intervals, matching


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, start long, end long")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_null_key_is_a_key(spark):
    a, b = spans(spark, (None, 0, 10), ("x", 0, 10)), spans(spark, (None, 2, 3), ("y", 2, 3))
    assert got(intervals.subtract_spans(a, b, ["k"])) == sorted([(None, 0, 2), (None, 3, 10), ("x", 0, 10)], key=repr)
    lengths = spark.createDataFrame([(None, 10), ("x", 5)], "k string, length long")
    assert got(intervals.kept_spans(b, lengths, ["k"])) == sorted([(None, 0, 2), (None, 3, 10), ("x", 0, 5)], key=repr)
    kinds = spark.createDataFrame([(None, "freeze", 0, 6), (None, "black", 2, 4)], "k string, kind string, start long, end long")
    assert got(intervals.resolve_priority(kinds, ["k"], "kind", ["black"])) == [(None, "black", 2, 4), (None, "freeze", 0, 2), (None, "freeze", 4, 6)]
    assert got(intervals.merge_spans(spans(spark, (None, 0, 2), (None, 2, 5), (None, 7, 7)), ["k"])) == [(None, 0, 5)]


def test_repeated_spans_are_cut_each(spark):
    twice = spans(spark, ("x", 0, 10), ("x", 0, 10))
    assert got(intervals.subtract_spans(twice, spans(spark, ("x", 2, 3), ("x", 2, 3)), ["k"])) == [("x", 0, 2), ("x", 0, 2), ("x", 3, 10), ("x", 3, 10)]


def test_natural_names_of_any_length(spark):
    names = ["9" * 60, "1" + "0" * 60, "clip10", "clip2", "007", "7b", "a", "A1", "10" * 30 + "x", "", "clip02"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["", "007", "7b", "10" * 30 + "x", "9" * 60, "1" + "0" * 60, "a", "A1", "clip02", "clip2", "clip10"]


@pytest.mark.parametrize(("text", "ms", "why"), [("9" * 20, None, "unreadable"), ("9" * 20 + ":00", None, "unreadable"), ("999999999999", 999999999999000, None), ("1:02.5", 62500, None), ("", None, "empty"), ("1.2345", None, "too-precise"), (None, None, None)])
def test_typed_times(spark, text, ms, why):
    r = spark.createDataFrame([(text,)], "t string").select(S.parse_time(F.col("t")).alias("ms"), S.time_refusal(F.col("t")).alias("why")).first()
    assert (r["ms"], r["why"]) == (ms, why)


def test_times_before_zero_have_no_text(spark):
    rows = spark.createDataFrame([(-500,), (0,), (500,), (3_600_000,), (61_250,)], "ms long").select(S.format_time(F.col("ms")).alias("t")).collect()
    assert [r["t"] for r in rows] == [None, "0:00", "0:00.5", "1:00:00", "1:01.25"]


def test_an_empty_chapter_takes_clips(spark):
    refs = spark.createDataFrame([("e", "full", 1, "a")], "event string, chapter string, pos long, clip string")
    added = spark.createDataFrame([("e", "empty", "b", 1), ("e", "none", "c", 2), ("e", "full", "d", 3), ("e", "full", "a", 4)], "event string, chapter string, clip string, n int")
    chapters = spark.createDataFrame([("e", "full"), ("e", "empty")], "event string, chapter string")
    assert got(edits.add_clips(refs, added, chapters)) == sorted([("e", "full", 1, "a", None), ("e", "empty", 1, "b", None), ("e", "none", None, "c", "no such chapter"), ("e", "full", 2, "d", None), ("e", "full", None, "a", "already there")], key=repr)


def test_tiles_begin_with_the_first(spark):
    points = spark.createDataFrame([("s", -5.0), ("s", 0.0), ("s", 99.0)], "k string, at double")
    strips = spark.createDataFrame([("s", 2.0, 10)], "k string, interval double, tiles int")
    assert [r["tile"] for r in edits.tiles_at(points, strips, "k").orderBy("at").collect()] == [0, 0, 9]


def test_a_repeated_chapter_shares_its_clips_once(spark):
    kind = "event string, chapter string, clips array<string>"
    wanted, old = spark.createDataFrame([("e", "new", ["a", "b"]), ("e", "new", ["a", "b"])], kind), spark.createDataFrame([("e", "old", ["a", "c"])], kind)
    rows = matching.pair_chapters(wanted, old).collect()
    assert {(r["wanted"], r["existing"], r["shared"]) for r in rows} == {("new", "old", 1)}


def test_scalars_without_a_query(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    text = F.lit
    assert one(S.etag_matches(text('W/"a", "b"'), text('"b"')), S.etag_matches(text("*"), text('"x"')), S.etag_matches(text('"c"'), text('"b"')), S.etag_matches(F.lit(None).cast("string"), text('"b"'))) == (True, True, False, False)
    assert one(S.changed_fields({"t": text(" a "), "l": text(""), "d": text("x")}, {"t": text("a"), "l": F.lit(None).cast("string"), "d": text("y")})) == (["d"],)
    p = S.pixel_format(F.lit("yuv420p10le")), S.pixel_format(F.lit("yuvj422p")), S.pixel_format(F.lit("rgb24"))
    assert [one(x["depth"], x["is_420"]) for x in p] == [(10, True), (8, False), (None, None)]
    assert one(S.frame_rate(text("0/0"), text("25/1")), S.frame_rate(text("30000/1001"), text("25/1")), S.frame_rate(text("2000/1"), text("x"))) == (25.0, 30000 / 1001, None)
    assert one(S.duration(text("N/A"), text("3.5")), S.duration(text("2"), text("3.5")), S.duration(F.lit(None).cast("string"), text(""))) == (3.5, 2.0, 0.0)
    assert one(S.progress(F.lit(5e6), F.lit(10.0), F.lit(False)), S.progress(F.lit(5e6), F.lit(10.0), F.lit(True)), S.progress(F.lit(5e7), F.lit(10.0), F.lit(False)), S.progress(F.lit(1.0), F.lit(0.0), F.lit(False))) == (0.5, 1.0, 1.0, None)


def test_cuts_without_bounds_and_extents_in_one_sort(spark):
    # a cut without a start begins at 0, one without an end goes on to the key's; a null key is a key; a key of two lengths has both
    cuts = spark.createDataFrame([("a", None, 5), ("a", 90, None), ("b", 10, 20), ("b", 20, 30), ("b", 50, 200), (None, 3, 4), (None, 9, 7), ("gone", 0, 1)], "clip string, start long, end long")
    extents = spark.createDataFrame([("a", 100), ("b", 100), ("b", 40), (None, 10), ("whole", 7), ("none", None), ("zero", 0)], "clip string, length long")
    got = sorted(map(tuple, intervals.kept_spans(cuts, extents, ["clip"]).collect()), key=str)
    assert got == sorted([("a", 5, 90), ("b", 0, 10), ("b", 30, 50), ("b", 0, 10), ("b", 30, 40), (None, 0, 3), (None, 4, 10), ("whole", 0, 7)], key=str)


def test_gaps_between_blockers_are_met_by_number(spark):
    kind = "clip string, start long, end long"
    spans = spark.createDataFrame([("a", 0, 100), ("a", 12, 18), ("a", 20, 30), ("a", 15, 25), ("a", 60, 90), (None, 0, 5), ("b", 1, 2), ("a", 5, 5)], kind)
    blockers = spark.createDataFrame([("a", 10, 15), ("a", 14, 20), ("a", 30, 40), ("a", 90, 95), ("a", 7, 6), (None, 2, 3)], kind)
    got = sorted(map(tuple, intervals.subtract_spans(spans, blockers, ["clip"]).collect()), key=str)
    assert got == sorted([("a", 0, 10), ("a", 20, 30), ("a", 40, 90), ("a", 95, 100), ("a", 20, 30), ("a", 20, 25), ("a", 60, 90), (None, 0, 2), (None, 3, 5), ("b", 1, 2)], key=str)
