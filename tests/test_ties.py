"""Halves and ties fall as in the queries' SQL."""

import datetime as dt
import random

from oracle import connection, rows
from sprocket.operators import events, matching, sequences
from sprocket.plans import library, queries
from sprocket.plans.queries import SQL


def test_times_are_rounded_to_the_nearest_second(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda s: day + dt.timedelta(microseconds=round(s * 1_000_000))
    # a cut begins at 20000 and ends at 50000; the next frame lies 40 seconds later
    times = [19959.4, 19959.5, 19959.6, 19958.5, 19960.5, 49959.4, 49959.5, 49959.999999, 49960.0, 86399.5]
    c = connection()
    c.sql("create or replace view events as select * from (values " + ", ".join(f"({i}, TIMESTAMP '{at(t)}', 1)" for i, t in enumerate(times)) + ") v(event_id, ts, user_id)")
    c.sql(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id from events) to '{tmp_path}/events.parquet' (format parquet)")
    assert rows(library.skipped_positions(spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL["skipped_positions"]).df())


def test_spans_are_matched_in_one_sort(spark):
    kind = "clip string, index int, start double, end double"
    have = spark.createDataFrame([(None, 1, float("nan"), 2.0), (None, 2, 0.0, None), ("a", 1, 0.0, 1.0), ("a", 2, 5.0, 6.0)], kind)
    want = spark.createDataFrame([(None, 1, -0.0, None), (None, 2, float("nan"), 2.0), (None, 3, 7.0, 8.0), ("a", 1, 5.0, 7.0), ("a", 2, 0.5, 1.0), ("b", 1, 0.0, 1.0)], kind)
    got = matching.match_spans(have, want, ["clip"])
    assert set(map(tuple, got.collect())) == {(None, 1, 2, "same"), (None, 2, 1, "same"), (None, 3, None, None), ("a", 1, 2, "start"), ("a", 2, 1, "end"), ("b", 1, None, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Sort") == 1 and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_places_are_ordered_by_clip(spark):
    rows = [("e", f"c{(i * 7) % 20:02}", 1) for i in range(20)]
    x = spark.createDataFrame(rows, "event string, clip string, pos long")
    assert [r["clip"] for r in events.kept_order(x, x, ["event"]).orderBy("pos").collect()] == [f"c{i:02}" for i in range(20)]


def test_the_late_one_of_the_heaviest_runs_is_kept():
    def made(ranks, weights):
        """All runs, short ones first; of a length, those with the latest rows behind the first, then the earliest first."""
        runs = [[i] for i in range(len(ranks))]
        while runs:
            yield from ((r, sum(weights[i] for i in r)) for r in runs)
            runs = [r + [j] for j in reversed(range(len(ranks))) for r in runs if j > r[-1] and ranks[j] > ranks[r[-1]]]

    random.seed(5)
    for _ in range(500):
        n = random.randint(1, 8)
        ranks, weights = [random.randint(0, 7) for _ in range(n)], [float(random.randint(0, 3)) for _ in range(n)]
        best = max(made(ranks, weights), key=lambda x: x[1])[0]  # max takes the first
        assert [i for i, k in enumerate(sequences.kept_in_order(ranks, weights, late=True)) if k] == best


def test_moved_clips_with_equal_runs(spark, tmp_path):
    # two heaviest runs of one length, runs of different length, no text at all, empty texts, one text missing
    lengths = {4183: [240, 947, 243, 1225, 337, 337, 241], 22: [2, 1, 1, 2, 2], 33: [None, None], 44: [0, 0, 0], 55: [5, None, 5]}
    c = connection()
    values = ", ".join(f"({k}, {t}, {'NULL' if n is None else repr('x' * n)})" for k, v in lengths.items() for t, n in enumerate(v))
    c.sql(f"create or replace view conversations as select k::bigint as conv_id, t::bigint as turn, x::varchar as text from (values {values}) v(k, t, x)")
    c.sql(f"copy (select * from conversations) to '{tmp_path}/conversations.parquet' (format parquet)")
    assert rows(queries.moved_clips(spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL["moved_clips"]).df())
