import datetime as dt

import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.functions import scalars as S
from sprocket.operators import catalog, intervals, joins, sequences
from sprocket.plans import queries as Q
from sprocket.plans import registry
from sprocket.sources import listings
from sprocket.streaming import feed


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("cuts", "kept"),
    [
        ([(0, 2)], [(2, 10)]),
        ([(8, 10)], [(0, 8)]),
        ([(1, 3), (2, 4)], [(0, 1), (4, 10)]),
        ([(1, 3), (3, 5)], [(0, 1), (5, 10)]),
        ([(1, 9), (2, 3)], [(0, 1), (9, 10)]),
        ([(5, 8), (1, 3), (2, 6)], [(0, 1), (8, 10)]),
        ([], [(0, 10)]),
    ],
)
def test_kept_spans(spark, cuts, kept):
    c = spark.createDataFrame([("a", *x) for x in cuts], "k string, start long, end long")
    e = spark.createDataFrame([("a", 10)], "k string, length long")
    got = intervals.kept_spans(c, e, ["k"]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == kept


def test_priority(spark):
    rows = [("a", "freeze", 0, 6), ("a", "black", 2, 4), ("b", "black", 0, 5), ("b", "freeze", 1, 4), ("c", "black", 0, 5), ("c", "freeze", 3, 9)]
    got = intervals.resolve_priority(spark.createDataFrame(rows, "k string, kind string, start long, end long"), ["k"], "kind", ["black", "white"])
    assert sorted(map(tuple, got.collect())) == [("a", "black", 2, 4), ("a", "freeze", 0, 2), ("a", "freeze", 4, 6), ("b", "black", 0, 5), ("c", "black", 0, 5), ("c", "freeze", 5, 9)]


def test_reconcile(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = joins.reconcile(one("k1", "Dock/k7", "spare", "fresh"), one("k1", "k2", "Dock/k7"), one("spare"), "id")
    assert dict(got.collect()) == {"k1": "active", "Dock/k7": "active", "k2": "missing", "fresh": "new", "spare": "ignored"}


def test_asof_first(spark):
    tiles = spark.createDataFrame([(1, float(t)) for t in range(0, 3)], "k int, t double")
    frames = spark.createDataFrame([(1, 0.48 * i, i) for i in range(1, 6)], "k int, t double, n int")
    got = {r["t"]: r["n"] for r in joins.asof_join(tiles, frames, ["k"], "t", "n", first_if_none=True).collect()}
    assert got == {0.0: 1, 1.0: 2, 2.0: 4}


def test_natural_order(spark):
    names = ["CAM_812.mp4", "cam_791.mp4", "take12.mp4", "take3.mp4"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["cam_791.mp4", "CAM_812.mp4", "take3.mp4", "take12.mp4"]


def test_scalars(spark):
    x = spark.createDataFrame([("30000/1001", "1:02:03.5", "2024-02-30 - Trip - Oslo", "a/b\\c", "Göteborg")], "r string, t string, f string, s string, u string")
    p = S.name_parts(F.col("f"))
    r = x.select(S.rational(F.col("r")), S.parse_time(F.col("t")), p["event_date"], F.array_join(p["problems"], ","), S.safe_name(F.col("s")), S.fold("u"), S.format_time(S.parse_time(F.col("t"))), S.title_case(F.lit("the house of 3rd street")), S.escape_metadata(F.lit("a=b;c"))).first()
    assert abs(r[0] - 29.97002997) < 1e-6
    assert list(r)[1:] == [3723500, None, "impossible-date", "a-b-c", "göteborg", "1:02:03.5", "The House of 3rd Street", "a\\=b\\;c"]


def test_filmstrip(spark):
    p = S.filmstrip(F.col("d"))
    got = spark.createDataFrame([(1.5,), (31.0,), (130.5,), (4807.0,)], "d double").select(*p.values()).collect()
    assert [tuple(r) for r in got] == [(1, 2, 2, 1), (1, 31, 10, 4), (2, 66, 10, 7), (41, 118, 10, 12)]


def test_moved():
    assert sequences.kept_in_order([1, 3, 2, 4], [1.0] * 4).count(True) == 3
    assert sequences.kept_in_order([], []) == []


def test_listings(spark):
    log = "black_start:0 black_end:3\nfreeze_start: 1\nfreeze_start: 2\nfreeze_end: 4\nfreeze_start: 8"
    x = spark.createDataFrame([("a", log, 10.0)], "id string, log string, len double")
    assert [tuple(r) for r in listings.black_spans(x, "id", "log").collect()] == [("a", 0.0, 3.0)]
    assert [tuple(r) for r in listings.freeze_spans(x, "id", "log", "len").collect()] == [("a", 2.0, 4.0), ("a", 8.0, 10.0)]
    j = spark.createDataFrame([('{"streams":[{"codec_type":"video","width":4,"height":3}],"format":{"duration":"2.5"}}',), ("junk",)], "json string")
    assert sorted((r["seconds"], r["problem"]) for r in listings.probe(j).collect() if r["problem"] is None) == [(2.5, None)]
    assert listings.probe(j).filter("problem is not null").count() == 1


def test_job_log(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "queued", t), (1, "done", t + dt.timedelta(1)), (1, "running", t + dt.timedelta(2)), (2, "queued", t)], "id int, status string, at timestamp")
    assert {r["id"]: r["status"] for r in catalog.current_jobs(log).collect()} == {1: "done", 2: "queued"}


def test_registry(spark):
    x = spark.createDataFrame([("e", "c", 1, "source")], "event string, chapter string, pos int, kind string")
    assert registry.apply(x).count() == 2
    assert registry.apply(x, []).count() == 1
    with pytest.raises(KeyError):
        registry.apply(x, ["nope"])


def test_feed(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "queued", 0.0, t), (1, "running", 0.5, t + dt.timedelta(seconds=1)), (1, "done", 1.0, t + dt.timedelta(seconds=2)), (1, "done", 1.0, t + dt.timedelta(seconds=2)), (1, "running", 0.7, t + dt.timedelta(seconds=3))]
    schema = "id long, status string, progress double, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("once", feed.finished), ("state", feed.merged)):
        q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("update" if name == "state" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["status"] for r in spark.table("once").collect()] == ["done"]
    assert [r["status"] for r in spark.table("state").orderBy("at").collect()] == ["queued", "running", "done"]


def test_folds_hold_no_groups(spark):
    import hashlib

    from sprocket.operators import sequences

    rows = [("a", i, i * 7 % 1000) for i in range(25_000)] + [("b", None, 2), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, x long, y long").repartition(5)
    digest, eta = sequences.ordered_hash(df, ["k"], ["x", "y"]), sequences.eta(df, "k", "x", "y")
    for out in (digest, eta):
        assert "collect_list" not in out._jdf.queryExecution().toString()
    want = {k: hashlib.sha256("\n".join(sorted("|".join("\\N" if v is None else str(v) for v in r[1:]) for r in rows if r[0] == k)).encode()).hexdigest() for k in ("a", "b", None)}
    assert {r["k"]: r["digest"] for r in digest.collect()} == want
    rate, n, before = None, 0, None
    for _, t, p in rows[:25_000]:
        if before is None or p < before[1]:
            rate, n = None, 1
        else:
            now = (p - before[1]) / (t - before[0])
            rate, n = now if rate is None else 0.3 * now + (1 - 0.3) * rate, n + 1
        before = (t, p)
    # an observation without a time is none
    assert {r["k"]: (r["rate"], r["observations"]) for r in eta.collect()} == {"a": (rate, n), None: (None, 1)}


def brute_moved(ranks, weights):
    """The greatest weight of an increasing run, by trying all subsets."""
    best = 0.0
    for mask in range(1 << len(ranks)):
        run = [i for i in range(len(ranks)) if mask >> i & 1]
        if all(ranks[a] < ranks[b] for a, b in zip(run, run[1:])):
            best = max(best, sum(weights[i] for i in run))
    return best


def test_moved_by_brute_force():
    import random

    r = random.Random(4)
    for _ in range(200):
        n = r.randint(0, 9)
        ranks, weights = [r.randint(0, 6) for _ in range(n)], [r.choice([0.5, 1.0, 2.0, 3.5]) for _ in range(n)]
        kept = sequences.kept_in_order(ranks, weights)
        run = [x for x, k in zip(ranks, kept) if k]
        assert run == sorted(set(run)) and sum(w for w, k in zip(weights, kept) if k) == brute_moved(ranks, weights)
    assert sum(sequences.kept_in_order(list(range(50_000)), [1.0] * 50_000)) == 50_000


def test_chapters_are_paired_by_name(spark):
    from sprocket.operators import matching

    schema = "event string, chapter string, pos int, clips array<string>"
    want = spark.createDataFrame([("e", "Dock", 1, ["a", "b"]), ("e", "Pier", 2, ["c"]), ("e", "", 3, ["x"]), ("f", "Dock", 1, ["a"])], schema)
    have = spark.createDataFrame([("e", "old", 1, ["a", "c", "d"]), ("e", "same", 2, ["c"]), ("e", "none", 3, ["y"]), ("f", None, 1, ["b"])], schema)
    got = sorted(tuple(r) for r in matching.pair_chapters(want, have, order="pos").select("event", "wanted", "existing", "shared").collect())
    assert got == [("e", "Dock", "old", 1), ("e", "Pier", "same", 1)]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_spans_of_a_hot_key(spark, kind):
    """A third of all spans lie under one key; fractions of seconds stay."""
    import random

    r = random.Random(6)
    unit = 1 if kind == "long" else 0.25
    rows = [(1 if i % 3 == 0 else i % 40, "xyz"[i % 3], r.randrange(4000) * unit, 0) for i in range(900)]
    rows = [(k, c, s, s + r.randrange(-2, 30) * unit) for k, c, s, _ in rows] + [(2, "x", None, 3 * unit), (2, "y", 5 * unit, 5 * unit)]
    df = spark.createDataFrame(rows, f"k int, kind string, start {kind}, end {kind}")
    cuts, spans = df.filter("kind = 'x'").drop("kind"), df.filter("kind <> 'x'")
    real = [t for t in rows if t[2] is not None and t[2] < t[3]]
    grid = lambda s, e: {x for x in range(round(s / unit), round(e / unit))}
    cover = {}
    for k, c, s, e in real:
        if c == "x":
            cover.setdefault(k, set()).update(grid(s, e))
    want = sorted((k, c, x) for k, c, s, e in real if c != "x" for x in grid(s, e) - cover.get(k, set()))
    got = [tuple(t) for t in intervals.subtract_spans(spans, cuts, ["k"], ["kind"]).collect()]
    assert sorted((k, c, x) for k, c, s, e in got for x in grid(s, e)) == want
    assert {t["k"]: t["covered"] for t in intervals.measure(cuts, ["k"]).collect()} == {k: len(v) * unit for k, v in cover.items()}
    states = {(t["k"], t["start"], t["end"]): t["state"] for t in intervals.cover_state(spans.filter("start < end"), cuts, ["k"]).collect()}
    for k, c, s, e in real:
        if c != "x":
            g = grid(s, e)
            assert states[k, s, e] == ("cut" if g <= cover.get(k, set()) else "partly-cut" if g & cover.get(k, set()) else "pending")


def test_span_matching_by_brute_force(spark):
    import random

    from sprocket.operators import matching

    r = random.Random(2)
    make = lambda: [(k, i, r.choice([None, 1, 2, 3]), r.choice([4, 5, None])) for k in range(12) for i in range(r.randrange(6))]
    have, want = make(), make()
    schema = "clip int, index int, start int, end int"
    got = {(x["clip"], x["want"]): (x["have"], x["rule"]) for x in matching.match_spans(spark.createDataFrame(have, schema), spark.createDataFrame(want, schema), ["clip"]).collect()}
    expected = {}
    for k in range(12):
        h, w = [x for x in have if x[0] == k], [x for x in want if x[0] == k]
        for rule, same in (("same", lambda a, b: a[2:] == b[2:]), ("start", lambda a, b: a[2] == b[2]), ("end", lambda a, b: a[3] == b[3]), ("order", lambda a, b: True)):
            for x in list(w):
                y = next((y for y in h if same(x, y)), None)
                if y:
                    expected[k, x[1]] = (y[1], rule)
                    h.remove(y)
                    w.remove(x)
        expected |= {(k, x[1]): (None, None) for x in w}
    assert got == expected
