from sprocket.operators import matching, timeline

from pyspark.sql import functions as F


def frames(spark, f, ms, fps):
    return spark.range(1).select(f(F.lit(ms), F.lit(fps))).first()[0]


def test_frames(spark):
    assert frames(spark, timeline.frame_ms, 1, 29.97) == 33
    assert frames(spark, timeline.nearest_frame, 59, 25) == 40 and frames(spark, timeline.nearest_frame, 60, 25) == 80
    grid = [int(i * 1000 / 29.97 + 0.5) for i in range(400)]
    for ms in (0, 1, 33, 34, 66, 67, 99, 100, 101, 9999):
        assert frames(spark, timeline.frame_at_or_below, ms, 29.97) == max(g for g in grid if g <= ms)
        assert frames(spark, timeline.frame_at_or_above, ms, 29.97) == min(g for g in grid if g >= ms)


def test_extents(spark):
    clips = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000), ("d", 1000)], "clip string, length long")
    cuts = spark.createDataFrame([("a", -5, 100), ("a", 100, 200), ("a", 850, 950), ("b", 0, 1200), ("c", 300, 400)], "clip string, start long, end long")
    got = {r["clip"]: (r["in_at"], r["out_at"]) for r in timeline.kept_extents(cuts, clips, ["clip"]).collect()}
    assert got == {"a": (200, 850), "b": (0, 0), "c": (0, 1000), "d": (0, 1000)}
    assert [tuple(r) for r in timeline.interior_spans(cuts, clips, ["clip"]).collect()] == [("c", 300, 400)]


def test_span_rules(spark):
    s = "clip string, index long, start long, end long"
    have = spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 5, 7), ("a", 2, 9, None), ("a", 3, 20, 30)], s)
    want = spark.createDataFrame([("a", 0, 5, 8), ("a", 1, 9, None), ("a", 2, 1, 2), ("a", 3, 40, 50), ("a", 4, 60, 70)], s)
    got = {r["want"]: (r["have"], r["rule"]) for r in matching.match_spans(have, want, ["clip"]).collect()}
    assert got == {0: (1, "start"), 1: (2, "same"), 2: (0, "end"), 3: (3, "order"), 4: (None, None)}


def test_chapters_pair_once(spark):
    s = "event string, chapter long, clips array<string>"
    wanted = spark.createDataFrame([("e", 0, ["a", "b"]), ("e", 1, ["c", "d", "x"]), ("e", 2, []), ("e", 3, ["c"])], s)
    existing = spark.createDataFrame([("e", 0, ["c", "d", "b"]), ("e", 1, ["a", "b"]), ("f", 0, ["c"])], s)
    got = sorted(tuple(r) for r in matching.pair_chapters(wanted, existing).select("wanted", "existing", "shared").collect())
    assert got == [(0, 1, 2), (1, 0, 2)]


def test_snap_takes_the_earlier(spark):
    p = spark.createDataFrame([("a", 100), ("a", 290), ("a", 1000)], "clip string, at long")
    c = spark.createDataFrame([("a", 0), ("a", 200), ("a", 301)], "clip string, candidate long")
    got = {r["at"]: r["target"] for r in timeline.snap(p, c, ["clip"], "at", 40).collect()}
    assert got == {100: 0, 290: 301, 1000: None}


def test_empty_tables(spark):
    cuts = spark.createDataFrame([], "clip string, start long, end long")
    clips = spark.createDataFrame([], "clip string, length long, fps int")
    for df in (timeline.kept_extents(cuts, clips, ["clip"]), timeline.trim_limits(cuts, clips, ["clip"]), timeline.snap_candidates(cuts, clips, ["clip"]), timeline.check_cuts(cuts, cuts, clips, ["clip"])):
        assert df.count() == 0
