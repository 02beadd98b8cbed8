"""Cases of events, documents and sweeps beyond the registered queries' rows."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from sprocket.operators import events as E
from sprocket.operators import timeline as T
from sprocket.sources import documents as D
from sprocket.sources import sidecars
from sprocket.streaming import feed


def test_hash_is_of_sorted_keys(spark):
    trees = [{"b": 1, "a": [1.5, None, {"z": "é", "y": True}]}, [], "x", 12345678901234567890]
    got = spark.createDataFrame([(json.dumps(t),) for t in trees], "j string").select(sidecars.canonical_hash("j").alias("h")).collect()
    assert [r.h for r in got] == [hashlib.sha256(json.dumps(t, sort_keys=True).encode()).hexdigest() for t in trees]


@pytest.mark.parametrize(("cuts", "lead", "trail", "played"), [([], 0, 1000, 1000), ([(0, 1000)], 1000, 0, 0), ([(-5, 300), (200, 400)], 400, 1000, 600), ([(950, 960)], 0, 950, 990), ([(0, 100), (950, 1200)], 100, 950, 850)])
def test_edges_and_played(spark, cuts, lead, trail, played):
    c = spark.createDataFrame([("a", *x) for x in cuts], "k string, start long, end long")
    e = spark.createDataFrame([("a", 1000)], "k string, length long")
    r = T.edge_places(c, e, ["k"]).first()
    assert (r.lead, r.trail) == (lead, trail)
    assert E.played_time(c, e, ["k"]).first().played == played


def test_events_without_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    chapters, refs = none("event string, chapter string, pos int"), none("event string, chapter string, pos long, clip string")
    listing, facts = none("event string, folder string, clip string, place int"), none("event string, clip string, status string, excluded boolean, duration double, proxy string")
    assert E.event_detail(chapters, refs, listing, facts).count() == 0
    assert E.adopted(chapters, refs, listing, none("event string, clip string")).count() == 0


def test_layouts(spark):
    folders = spark.createDataFrame([("r", "2020/a", "2020", "x", False, False, 1), ("r", "b", None, "y", False, False, 2)], "root string, path string, year string, real string, linked boolean, marked boolean, pos int")
    with pytest.raises(ValueError, match="flat"):
        E.list_layout("nowhere", folders)
    E.register_layout("top", lambda f, years: f.filter(~F.col("path").contains("/")))
    assert [r.path for r in E.list_layout("top", folders).collect()] == ["b"]
    assert E.listed_event("year-event", folders, "2020/a").count() == 1
    assert E.listed_event("year-event", folders, "2020/b").count() == 0


def test_document_round_trip(spark):
    doc = {"version": 0, "chapters": [{"name": "", "clips": [f"{i}.mp4" for i in range(50)]}, {"name": "Dock", "clips": ["d"]}], "ignore": ["q"]}
    docs = D.read_documents(spark.createDataFrame([(1, json.dumps(doc))], "id int, j string"), "j")
    refs = [(r.chapter, r.pos, r.clip) for r in D.references(docs, "id").orderBy("chapter", "pos").collect()]
    assert refs == [("", i + 1, f"{i}.mp4") for i in range(50)] + [("Dock", 1, "d")]
    assert [tuple(r) for r in D.chapters(docs, "id").orderBy("pos").collect()] == [(1, "", 1), (1, "Dock", 2)]
    assert [tuple(r) for r in D.ignored(docs, "id").collect()] == [(1, "q")]


def test_sweep_at_intervals(spark):
    seen: list[int] = []
    q = feed.every(spark, lambda: spark.range(3), lambda df: seen.append(df.count()), "1 second", "sweep")
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert seen[:2] == [3, 3]
