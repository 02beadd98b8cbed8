"""Streams that are caught up, snapshots with deltas after them, and numbered commits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sprocket.sources.commits import Conflict, Log
from sprocket.streaming import feed

ROWS = feed.SNAPSHOT


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 12, minute)


def put(spark, path, rows):
    spark.createDataFrame([(i, s, float(p), at(m)) for i, s, p, m in rows], ROWS).coalesce(1).write.mode("append").parquet(path)


def told(df):
    return sorted((r["id"], r["status"], r["progress"], r["at"].minute) for r in df.collect())


def test_an_empty_source_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = feed.caught_up(feed.files(spark, str(tmp_path / "in"), ROWS).select("id", "status"), "empty")
    assert got.columns == ["id", "status"] and got.count() == 0


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    assert log.append(0, rows) and not log.append(0, rows) and log.append(1, rows)
    assert log.read(rows.schema).count() == 2 and log.numbers() == [0, 1]
    # an attempt that died before its marker
    rows.write.parquet(str(tmp_path / "t" / "rows" / "2-dead"))
    assert log.read(rows.schema).count() == 2 and log.append(2, rows) and log.read(rows.schema, 1).count() == 1


def test_a_stream_started_again_after_a_lost_checkpoint_commits_no_batch_twice(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, "running", 0.5, 1)])
    assert feed.caught_up(feed.files(spark, source, ROWS), "x", folder=folder).count() == 1
    # the batch is done but its commit in the checkpoint is lost: Spark runs it again under the same number
    for f in (tmp_path / "out" / "state" / "commits").iterdir():
        f.unlink()
    assert feed.caught_up(feed.files(spark, source, ROWS), "x", folder=folder).count() == 1
    put(spark, source, [(2, "running", 0.5, 2)])
    assert feed.caught_up(feed.files(spark, source, ROWS), "x", folder=folder).count() == 2


def test_versions_are_made_of_the_one_that_was_read(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "n long")
    assert log.put(-1, one) == 0
    with pytest.raises(Conflict):
        log.put(-1, one)
    n, rows = log.version("n long")
    assert n == 0 and rows.count() == 1
    calls = []

    def change(rows):
        calls.append(rows.count())
        if len(calls) == 1:  # another writer comes first
            log.put(0, one.union(one))
        return rows.union(one)

    assert log.update("n long", change) == 2 and calls == [1, 2] and log.version("n long")[1].count() == 3


def test_a_late_subscriber_gets_the_snapshot_once_and_each_change_once(spark, tmp_path):
    source = str(tmp_path / "in")
    snapshot = spark.createDataFrame([(1, "running", 0.5, at(1)), (2, "queued", 0.0, at(1)), (3, "done", 1.0, at(1))], ROWS)
    # 1 as told, then on; 2 unchanged; 3 has ended; 4 is new and ends at once, and is read twice
    put(spark, source, [(1, "running", 0.5, 2), (1, "running", 0.7, 3), (2, "queued", 0.0, 3), (3, "running", 0.1, 2), (4, "running", 0.0, 2), (4, "failed", 0.2, 3), (4, "failed", 0.2, 3), (4, "running", 0.9, 3)])
    got = feed.subscription(feed.files(spark, source, ROWS), snapshot, "late", "10 minutes")
    assert told(got.filter("kind = 'snapshot'")) == told(snapshot)
    assert told(got.filter("kind = 'delta'")) == [(1, "running", 0.7, 3), (4, "failed", 0.2, 3), (4, "running", 0.0, 2)]


def test_the_state_of_ended_jobs_goes(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    none = spark.createDataFrame([], ROWS)
    stream = lambda: feed.deltas(feed.files(spark, source, ROWS), none, "1 minute")
    put(spark, source, [(1, "done", 1.0, 1), (2, "running", 0.1, 1)])
    feed.caught_up(stream(), "s", "update", folder)
    for m in (10, 20, 30):
        put(spark, source, [(2, "running", m / 100, m)])
        feed.caught_up(stream(), "s", "update", folder)
    state = spark.read.format("statestore").option("stateVarName", "told").load(f"{folder}/state")
    assert [r["key"]["id"] for r in state.collect()] == [2]


def test_polls(spark):
    kind = "id long, status string, progress double"
    before = spark.createDataFrame([(1, "running", 0.1), (2, "running", 0.2), (3, "running", 0.3), (4, "queued", 0.0)], kind)
    active = spark.createDataFrame([(1, "running", 0.1), (2, "running", 0.6), (5, "queued", 0.0)], kind)
    ended = spark.createDataFrame([(3, "done", 1.0), (6, "failed", 0.4), (6, "failed", 0.4)], kind)
    assert sorted(map(tuple, feed.polled(before, active, ended).collect())) == [(2, "changed", "running", 0.6), (3, "ended", "done", 1.0), (4, "vanished", "queued", 0.0), (5, "new", "queued", 0.0), (6, "ended", "failed", 0.4)]


def test_a_failing_step_does_not_end_the_sweep(spark, tmp_path):
    import time

    seen = []

    def step():
        seen.append(len(seen))
        if len(seen) == 1:
            raise ValueError("once")
        return spark.range(1)

    q = feed.every(spark, step, lambda df: df.count(), "1 second", "sweep")
    try:
        began = time.time()
        while len(seen) < 3 and time.time() - began < 60:
            time.sleep(0.5)
        assert len(seen) >= 3 and q.exception() is None
    finally:
        q.stop()
    assert spark.range(1).select(F.lit(1)).count() == 1
