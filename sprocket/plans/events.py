"""Registered queries of events, sidecars and the sweep: odd cases for each of the given suppliers, and given tables as they are. Each stands beside its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog
from ..operators import events as E
from ..operators import timeline as T
from ..session import table
from ..sources import listings
from ..sources import sidecars as D
from .library import Cases, each
from .queries import MERGE_SQL, query

# ------------------------------------------------------------------ documents and disk

CHAPTERS = Cases("event string, chapter string, pos int", ("a", "", 2), ("a", "Dock", 1), ("b", "Yard", 1), ("b", "yard ", 2))
NAMED = Cases("event string, chapter string, pos int, clip string", ("a", "Dock", 1, "Dock/k1"), ("a", "", 1, "k2"), ("a", "", 2, "k9"), ("b", "Yard", 1, "Yard/m1"))
DISK = Cases(
    "event string, folder string, clip string, place int",
    ("a", "Dock", "Dock/k1", 1), ("a", "", "k2", 2), ("a", "dock", "dock/k4", 3), ("a", "Pier", "Pier/k5", 5), ("a", "", "k3", 4), ("a", "", "k6", 6), ("b", "yard", "yard/m2", 2), ("b", "", "m3", 1), ("c", "", "n1", 2), ("c", "Inn", "Inn/n2", 1), ("c", "Bay", "Bay/n3", 3),
)
CLIP_FACTS = Cases("event string, clip string, status string, excluded boolean, duration double, proxy string", ("a", "Dock/k1", "active", True, 4.0, "ready"), ("a", "k2", "active", None, 5.5, "absent"), ("a", "k6", "ignored", False, None, None), ("b", "Yard/m1", "missing", True, None, None), ("b", "m3", "new", False, 1.0, "stale"))
_PLACED = "CASE WHEN d.event NOT IN (SELECT event FROM ch) THEN folder ELSE coalesce((SELECT max(chapter) FROM ch WHERE ch.event = d.event AND chapter = folder), (SELECT arg_min(chapter, pos) FROM ch WHERE ch.event = d.event AND lower(chapter) = lower(folder)), '') END AS chapter"
_END = "coalesce((SELECT max(pos) FROM n WHERE n.event = p.event AND n.chapter = p.chapter), 0) + row_number() OVER (PARTITION BY event, chapter ORDER BY place, clip)"
_DETAIL = f"""(WITH ch AS {CHAPTERS.sql}, n AS {NAMED.sql}, d AS {DISK.sql}, f AS {CLIP_FACTS.sql}, p AS (SELECT d.*, {_PLACED} FROM d WHERE (event, clip) NOT IN (SELECT event, clip FROM n)),
r AS (SELECT event, chapter, pos, clip, 'missing' AS s FROM n UNION ALL SELECT event, chapter, {_END}, clip, 'new' FROM p)
SELECT r.event, dense_rank() OVER (PARTITION BY r.event ORDER BY ch.pos IS NULL, ch.pos, r.chapter) AS chapter_pos, r.chapter, CAST(r.pos AS BIGINT) AS pos, r.clip, coalesce(f.status, s) AS status, coalesce(excluded, FALSE) AS excluded, duration, proxy
FROM r LEFT JOIN ch ON ch.event = r.event AND ch.chapter = r.chapter LEFT JOIN f ON f.event = r.event AND f.clip = r.clip)"""


def detail(spark: SparkSession, sf: str) -> DataFrame:
    return E.event_detail(CHAPTERS.df(spark, sf), NAMED.df(spark, sf), DISK.df(spark, sf), CLIP_FACTS.df(spark, sf))


@query(f"SELECT * FROM {_DETAIL}")
def event_details(spark: SparkSession, sf: str) -> DataFrame:
    return detail(spark, sf)


@query(f"SELECT event, clip FROM {_DETAIL} WHERE status NOT IN ('ignored', 'missing') AND NOT excluded")
def shown_clips(spark: SparkSession, sf: str) -> DataFrame:
    return E.shown_clips(detail(spark, sf)).select("event", "clip")


@query(f"SELECT event, count(*) FILTER (status = 'missing' AND NOT excluded) AS missing, count(*) FILTER (status <> 'ignored' AND excluded) AS excluded FROM {_DETAIL} GROUP BY event")
def omitted_clips(spark: SparkSession, sf: str) -> DataFrame:
    return E.omitted_counts(detail(spark, sf))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'en') AND n_chars % 5 > 0")
def played_clips(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("lang") == "de", "active").when(F.col("lang") == "en", "new").otherwise("missing")
    return E.played_clips(table(spark, sf, "documents").select("doc_id", status.alias("status"), (F.col("n_chars") % 5 == 0).alias("excluded"))).select("doc_id")


@query(f"SELECT DISTINCT event, regexp_extract(clip, '^(.*)/[^/]*$', 1) AS folder FROM {_DETAIL} WHERE status <> 'missing'")
def disk_folders(spark: SparkSession, sf: str) -> DataFrame:
    return E.disk_folders(detail(spark, sf))


SKIPPED = Cases("event string, clip string", ("a", "k6"), ("a", "k3"), ("c", "n1"))


@query(f"""WITH ch AS {CHAPTERS.sql}, n AS {NAMED.sql}, d AS {DISK.sql}, p AS (SELECT d.*, {_PLACED} FROM d WHERE (event, clip) NOT IN (SELECT event, clip FROM n) AND (event, clip) NOT IN (SELECT event, clip FROM {SKIPPED.sql}))
SELECT event, chapter, pos, clip, FALSE AS entered FROM n UNION ALL SELECT event, chapter, {_END}, clip, TRUE FROM p""")
def adopted_clips(spark: SparkSession, sf: str) -> DataFrame:
    return E.adopted(CHAPTERS.df(spark, sf), NAMED.df(spark, sf), DISK.df(spark, sf), SKIPPED.df(spark, sf))


TO_IGNORE = Cases("event string, clip string", ("a", "k6"), ("a", "k2"), ("a", "new"), ("a", "new"), ("z", "k2"))


@query(f"SELECT event, clip, NULL::VARCHAR AS problem FROM {SKIPPED.sql} UNION ALL SELECT DISTINCT event, clip, CASE WHEN (event, clip) IN (SELECT event, clip FROM {NAMED.sql}) THEN 'in a chapter' END FROM {TO_IGNORE.sql} WHERE (event, clip) NOT IN (SELECT event, clip FROM {SKIPPED.sql})")
def newly_ignored(spark: SparkSession, sf: str) -> DataFrame:
    return E.ignored_after(SKIPPED.df(spark, sf), NAMED.df(spark, sf), TO_IGNORE.df(spark, sf))


@query("SELECT l_orderkey AS chapter, clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS pos FROM (SELECT l_orderkey, l_partkey AS clip, min(l_linenumber * 100000 + l_partkey) AS pos FROM lineitem GROUP BY 1, 2) x WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = clip AND p_size > 20)")
def kept_originals(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("clip")).agg(F.min(F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"))
    held = x.join(table(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("clip")), "clip", "left_semi")
    return E.kept_order(x, held, ["chapter"])


@query("SELECT event_type, user_id, event_id FROM events WHERE event_type = 'view' AND user_id = 7")
def listed_event(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "user_id", "event_id", F.concat_ws("/", "event_type", "user_id").alias("path"))
    folders = e.select(F.lit("r").alias("root"), "path", F.col("event_type").alias("year"), F.col("event_id").alias("real"), F.lit(False).alias("linked"), F.lit(False).alias("marked"), F.col("event_id").alias("pos"), "event_type", "user_id", "event_id")
    return E.listed_event("year-event", folders, "view/7").select("event_type", "user_id", "event_id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def flat_layout(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    folders = table(spark, sf, "supplier").select(F.lit("r").alias("root"), F.col("s_name").alias("path"), F.lit(None).cast("string").alias("year"), k.alias("real"), F.lit(False).alias("linked"), (k % 3 == 0).alias("marked"), k.alias("pos"), k)
    return E.list_layout("flat", folders, ["2020"]).select("s_suppkey")


@query("SELECT lower(o_orderpriority) AS path, count(*) AS n FROM orders GROUP BY 1")
def prune_keys(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("path"))
    # the few spellings are folded, not each row
    return paths.groupBy("path").count().groupBy(S.fold(F.col("path")).alias("key")).agg(F.sum("count").alias("n")).withColumnRenamed("key", "path")


# ------------------------------------------------------------------ time and cards

_CUT = "cuts AS (SELECT l_suppkey AS clip, (l_orderkey * 37) % 86400 AS s, least(86400, (l_orderkey * 37) % 86400 + l_linenumber * 300) AS e FROM lineitem WHERE l_returnflag = 'R')"


def _cuts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    start = F.col("l_orderkey") * 37 % 86400
    cuts = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("clip"), start.alias("start"), (start + F.col("l_linenumber") * 300).alias("end"))
    return cuts, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.col("s_nationkey").alias("event"), F.lit(86400).cast("long").alias("length"))


@query(f"WITH {_CUT}, m AS ({MERGE_SQL.format(src='cuts')}) SELECT s_suppkey AS clip, 86400 - CAST(coalesce(sum(e - s), 0) AS BIGINT) AS played FROM supplier LEFT JOIN m ON clip = s_suppkey GROUP BY 1")
def played_time(spark: SparkSession, sf: str) -> DataFrame:
    return E.played_time(*_cuts(spark, sf), ["clip"]).select("clip", "played")


@query(f"WITH {_CUT}, m AS ({MERGE_SQL.format(src='cuts')}), p AS (SELECT s_nationkey, s_suppkey, 86400 - coalesce(sum(e - s), 0) AS played FROM supplier LEFT JOIN m ON clip = s_suppkey GROUP BY 1, 2) SELECT s_nationkey AS event, CAST(sum(played) AS BIGINT) AS length FROM p GROUP BY 1")
def movie_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return E.movie_length(E.played_time(*_cuts(spark, sf), ["clip"]), "event")


@query(f"WITH {_CUT}, m AS ({MERGE_SQL.format(src='cuts')}) SELECT s_suppkey AS clip, CAST(coalesce(max(CASE WHEN s <= 0 THEN e END), 0) AS BIGINT) AS lead, CAST(coalesce(min(CASE WHEN 86400 - e < 100 THEN s END), 86400) AS BIGINT) AS trail FROM supplier LEFT JOIN m ON clip = s_suppkey GROUP BY 1")
def edge_places(spark: SparkSession, sf: str) -> DataFrame:
    return T.edge_places(*_cuts(spark, sf), ["clip"]).select("clip", "lead", "trail")


CARD_CLIPS = Cases("event string, chapter string, clip string, index int, length long", ("a", "x", "p", 1, 10000), ("a", "x", "q", 2, 10000), ("a", "y", "r", 3, 4000), ("a", "z", "s", 4, 5000), ("b", "x", "p", 1, 9000))
CARD_CUTS = Cases("event string, clip string, start long, end long", ("a", "p", 0, 9950), ("a", "q", 0, 1000), ("a", "q", 3000, 4000), ("a", "s", 0, 5000))
CARDS = Cases("event string, chapter string, seconds double, background string, error string, decorators string", ("a", "x", 4.0, "video", None, "on"), ("a", "y", 5.0, "black", None, "off"), ("a", "z", 3.0, "black", None, "on"), ("a", "w", None, None, "no such font", "on"), ("a", "v", 0.0004, "black", None, "on"), ("b", "x", 1.0, "video", None, "invalid"), ("b", "u", 2.0, "white", None, "invalid"))


@query(each("SELECT * FROM (VALUES ('a', 'x', 'anchored', 2, 1000, 2000, TRUE), ('a', 'y', 'off', 3, 0, 5000, FALSE), ('a', 'z', 'no-footage', NULL, NULL, NULL, NULL), ('a', 'w', 'unresolved', NULL, NULL, NULL, NULL), ('a', 'v', 'unreadable', NULL, NULL, NULL, NULL), ('b', 'u', 'unreadable', NULL, NULL, NULL, NULL)) v(event, chapter, kind, index, \"at\", width, clamped)", event="string"))
def card_placements(spark: SparkSession, sf: str) -> DataFrame:
    clips = CARD_CLIPS.df(spark, sf)
    first = clips.join(E.first_kept(CARD_CUTS.df(spark, sf), clips, ["event", "clip"]), ["event", "clip"])
    return E.card_placements(CARDS.df(spark, sf), first)


CARD_TEXTS = Cases("id int, name string, ct string, cs string, title string, d date, location string", (1, "", None, None, "Trip", "2024-05-01", " Oslo "), (2, "Dock", None, None, "Trip", "2024-05-01", "Oslo"), (3, "", "Own", "", "Trip", "2024-05-01", "Oslo"), (4, "", "", None, None, None, " "), (5, "Dock", "", "below", None, None, None), (6, "", None, None, "  ", None, "Oslo"))


@query(each("SELECT * FROM (VALUES (1, 'Trip', '2024-05-01' || chr(10) || 'Plats: Oslo', NULL), (2, 'Dock', '', NULL), (3, 'Own', '', NULL), (4, '', '', 'no heading'), (5, 'Dock', 'below', NULL), (6, '  ', 'Plats: Oslo', 'no heading')) v(id, heading, subtitle, problem)", id="int"))
def card_contents(spark: SparkSession, sf: str) -> DataFrame:
    return CARD_TEXTS.df(spark, sf).select("id", E.card_text(*map(F.col, ("name", "ct", "cs", "title", "d", "location"))).alias("t")).select("id", "t.*")


LOOKS = Cases("id int, event string, project string", (1, None, None), (2, "title,logo", "none"), (3, "none", "title"), (4, None, "logo"), (5, "", "title"))


@query(each("SELECT * FROM (VALUES (1, TRUE, 'default'), (2, TRUE, 'event'), (3, FALSE, 'event'), (4, FALSE, 'project'), (5, FALSE, 'event')) v(id, enabled, source)", id="int"))
def title_card_states(spark: SparkSession, sf: str) -> DataFrame:
    return LOOKS.df(spark, sf).select("id", E.title_cards(F.split("event", ","), F.split("project", ",")).alias("s")).select("id", "s.*")


# ------------------------------------------------------------------ sidecars

_PROXY = {"proxy_version": 1, "duration": 2.5, "fps": {"num": 25, "den": 1}, "vfr": None, "frames": 5, "width": 10, "height": 10, "source_width": 1, "source_height": 2, "rotation": None, "audio_codec": None, "encode_path": "cpu", "fallback_reason": None}
_CHANGES: list[dict[str, object]] = [{}, {"duration": 3}, {"width": 10.0}, {"vfr": 1}, {"rotation": 360}, {"rotation": 0, "vfr": False}, {"proxy_version": 2}, {"duration": True}, {"fps": {"num": 25}}, {"height": 0}, {"audio_codec": "aac", "duration": 1e300}, {"encode_path": None}, {"fps": 25}]
PROXIES = Cases("id int, json string", *((i, json.dumps(_PROXY | c)) for i, c in enumerate(_CHANGES)), (20, "junk"), (21, None), (22, "[1]"), (23, json.dumps({k: v for k, v in _PROXY.items() if k != "vfr"})))


_GOOD = each("SELECT * FROM (VALUES (0, 2.5::DOUBLE), (1, 3.0), (5, 2.5), (10, 1e300)) v(id, duration)", id="int")


@query(f"SELECT p.id, v.duration FROM {PROXIES.sql} p LEFT JOIN ({_GOOD}) v USING (id)")
def proxy_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    return D.proxy_facts(PROXIES.df(spark, sf), "json", 1).select("id", "facts.duration")


RATES = Cases("id int, base string, average string, frames string, seconds string", (1, "30000/1001", "30000/1001", "5", "2.0"), (2, "50/2", "0/0", "N/A", "N/A"), (3, "0/0", "48/2", "-1", "inf"), (4, None, "x", None, None), (5, "100/1", "101/1", "1", "0"), (6, "100/1", "1011/10", " 1 ", "1e2"))


@query(each("SELECT * FROM (VALUES (1, 30000, 1001, FALSE, 5, 2.0::DOUBLE, NULL), (2, 25, 1, NULL, NULL, NULL, NULL), (3, 24, 1, FALSE, NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL, NULL, 'no usable rate'), (5, 100, 1, FALSE, 1, NULL, NULL), (6, 100, 1, TRUE, 1, 100.0, NULL)) v(id, fps_num, fps_den, vfr, declared_frames, video_seconds, problem)", id="int"))
def source_facts(spark: SparkSession, sf: str) -> DataFrame:
    return D.source_facts(RATES.df(spark, sf), "base", "average", "frames", "seconds").drop("base", "average", "frames", "seconds")


MARKERS = Cases(
    "id int, path string, json string",
    (1, "/m/a/k.mp4", json.dumps({"reason": "could not read: Command exited 1: ffmpeg -i /m/a/k.mp4\nstderr:\nfirst\n[mov @ 0x1] [x] /m/a/k.mp4: Invalid data in '/m/a/k.mp4'\n\n"})),
    (2, "/m/k.mp4", json.dumps({"reason": "no space in /var/cache/x\nmore"})), (3, "/m/k.mp4", '{"reason": "  "}'), (4, "/m/k.mp4", '{"reason": 5}'), (5, "/m/k.mp4", "junk"), (6, "/m/k.mp4", '["reason"]'), (7, "/m/k.mp4", None),
    (8, "/m/k.mp4", json.dumps({"reason": "rate 0/0 of (/m/other) is odd"})), (9, "/m/k.mp4", json.dumps({"reason": "probe: Command exited -9: x"})), (10, "/m/k.mp4", json.dumps({"reason": "k.mp4 of /m/k.mp4"})),
)


@query(each("SELECT * FROM (VALUES (1, 'could not read: Invalid data in ''k.mp4'''), (2, 'no space in'), (3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, 'rate 0/0 of'), (9, 'probe'), (10, 'k.mp4 of k.mp4')) v(id, cause)", id="int"))
def failure_causes(spark: SparkSession, sf: str) -> DataFrame:
    return MARKERS.df(spark, sf).select("id", D.failure_cause("json", "path").alias("cause"))


HELD = Cases("event string, clip string, json string", ("a", "k", "old"), ("a", "m", "old"), ("b", "k", "old"))


RESULTS = Cases("event string, clip string, size long, mtime_ns long, segments string", ("a", "k", 1, 2, '[{"start": 0, "end": 1.5, "kind": "black"}]'), ("a", "n", 5, 6, "[]"))
FAILURES = Cases("event string, clip string, size long, mtime_ns long, reason string", ("a", "m", 3, 4, "broken"), ("a", "n", 5, 6, "late"))


@query(each("""SELECT * FROM (VALUES ('a', 'k', '{"version":1,"identity":"k","signal":{"size":1,"mtime_ns":2},"segments":[{"start":0.0,"end":1.5,"kind":"black"}]}'), ('a', 'm', '{"version":1,"identity":"m","signal":{"size":3,"mtime_ns":4},"failure":"broken"}'), ('a', 'n', '{"version":1,"identity":"n","signal":{"size":5,"mtime_ns":6},"segments":[]}'), ('b', 'k', 'old')) v(event, clip, json)""", event="string"))
def written_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    results = RESULTS.df(spark, sf).withColumn("segments", F.from_json("segments", "array<struct<start:double,end:double,kind:string>>"))
    failures = FAILURES.df(spark, sf)
    return D.written_entries(HELD.df(spark, sf), results, failures)


@query("SELECT p_partkey AS key, CASE WHEN p_size % 4 = 0 THEN 'there' ELSE 'b' || n END AS json, p_size % 4 <> 0 AS generated FROM part JOIN (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey UNION ALL SELECT p_partkey, 'there', FALSE FROM part WHERE p_size % 4 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def published_proxies(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 4 == 0, "there").alias("json"))
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return D.published(entries, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.concat(F.lit("b"), n).alias("json"), n.alias("n")))


TREES = Cases("id int, json string", (1, '{"b": [1, 2.5, "x"], "a": {"d": null, "c": true}}'), (2, '{ "a":{"c":true,"d":null},"b":[1,2.5,"x"]}'), (3, "[]"), (4, "{"), (5, None), (6, '{"å": "é"}'))


@query(each("""SELECT * FROM (VALUES (1, sha256('{"a": {"c": true, "d": null}, "b": [1, 2.5, "x"]}')), (2, sha256('{"a": {"c": true, "d": null}, "b": [1, 2.5, "x"]}')), (3, sha256('[]')), (4, NULL), (5, NULL), (6, sha256('{"\\u00e5": "\\u00e9"}'))) v(id, hash)""", id="int"))
def document_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return TREES.df(spark, sf).select("id", D.canonical_hash("json").alias("hash"))


@query(f"SELECT r_regionkey, sha256('{D.PROXY_SPEC}') AS digest FROM region")
def spec_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select("r_regionkey", D.spec_digest().alias("digest"))


STAMPS = Cases("id int, said string", (1, "2024-05-01T10:00:00Z"), (2, " 2024-05-01 10:00:00.5+02:00"), (3, "2024-05-01"), (4, "2024-02-30T10:00:00"), (5, "x"), (6, None), (7, "2024-05-01T10:00:00,25-0130"), (8, "2024-05-01T10:00"), (9, "2024-05-01Z"), (10, "2024-05-01T10:00:00+25:00"))


@query(each("SELECT * FROM (VALUES (1, '2024-05-01 10:00:00', 0), (2, '2024-05-01 10:00:00.5', 7200), (3, '2024-05-01 00:00:00', NULL), (4, NULL, NULL), (5, NULL, NULL), (6, NULL, NULL), (7, '2024-05-01 10:00:00.25', -5400), (8, '2024-05-01 10:00:00', NULL), (9, NULL, NULL), (10, NULL, NULL)) v(id, local, zone)", id="int"))
def recorded_times(spark: SparkSession, sf: str) -> DataFrame:
    return STAMPS.df(spark, sf).select("id", D.recorded_at(F.col("said")).alias("t")).select("id", F.col("t.local").cast("string").alias("local"), F.col("t.offset").alias("zone"))


MANIFESTS = Cases(
    "id int, json string",
    (1, '{"written_at": "2024-05-01T10:00:00+02:00", "fingerprint": "0123456789abcdef", "chapters": [{"name": "x", "start_ms": 0}, {"name": "y", "start_ms": 2500}]}'), (2, '{"written_at": "2024-05-01T10:00:00", "fingerprint": "ab", "chapters": []}'),
    (3, None), (4, '{"written_at": "2024-05-01T10:00:00Z", "fingerprint": "ab"}'),
)


@query(each("SELECT * FROM (VALUES (1, '2024-05-01 08:00:00', '0123456789ab', '0.0,2.5'), (2, NULL, NULL, NULL), (3, NULL, NULL, NULL), (4, '2024-05-01 10:00:00', 'ab', NULL)) v(id, \"at\", fingerprint, starts)", id="int"))
def movie_facts(spark: SparkSession, sf: str) -> DataFrame:
    x = D.movie_facts(MANIFESTS.df(spark, sf).withColumn("manifest", F.from_json("json", "struct<written_at:string,fingerprint:string,chapters:array<struct<name:string,start_ms:bigint>>>")))
    return x.select("id", F.col("movie.recorded_at").cast("string").alias("at"), "movie.fingerprint", F.when(F.col("movie.chapters").isNotNull(), F.array_join(F.transform("movie.chapters", lambda c: c["start"].cast("string")), ",")).alias("starts"))


LEGACY = Cases(
    "id int, json string",
    (1, '{"metadata": {"title": "inner", "location": "Oslo", "mood": 1}, "title": "2024-05-01 - Trip", "description": "d", "title_card": {"font": "x"}, "sort": {"method": "Custom", "custom_order": {"a.mp4": 2}, "reverse": true}, "extra": 0}'),
    (2, '{"metadata": 5, "title_card": "x", "sort": {"method": "size"}}'), (3, '{"sort": {"reverse": 1, "custom_order": {"a": 1}}, "metadata": {"title": "T", "date": "2024-05-02"}}'), (4, '{"title": "2024-05-01 - Trip", "metadata": {"date": "2024-05-02"}, "sort": []}'), (5, "junk"), (6, '{"sort": {"method": "custom", "custom_order": {"a": 1.5}}, "metadata": null}'),
)


@query(each("""SELECT * FROM (VALUES (1, 'Trip', '2024-05-01', 'Oslo', 'd', '{"font":"x"}', 'custom', TRUE, 'extra,metadata.mood'), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'metadata:type,sort.method:unknown,title_card:type'),
(3, 'T', '2024-05-02', NULL, NULL, NULL, 'datetime', NULL, 'sort.custom_order:unused,sort.reverse:type'), (4, '2024-05-01 - Trip', '2024-05-02', NULL, NULL, NULL, NULL, NULL, 'sort:type'), (5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (6, NULL, NULL, NULL, NULL, NULL, 'custom', NULL, 'sort.custom_order:type')) v(id, title, date, location, description, look, method, reverse, unmapped)""", id="int"))
def legacy_documents(spark: SparkSession, sf: str) -> DataFrame:
    x = D.legacy_documents(LEGACY.df(spark, sf), "json")
    return x.withColumns({"unmapped": F.array_join("unmapped", ","), "date": F.col("date").cast("string")}).drop("json", "custom_order")


@query(each("SELECT * FROM (VALUES ('a', 'black', 0.0::DOUBLE, 3.0::DOUBLE, 0.5::DOUBLE), ('a', 'freeze', 2.0, 4.0, 0.5), ('a', 'freeze', 8.0, 10.0, 0.5)) v(id, kind, start, \"end\", confidence)", id="string"))
def first_pass(spark: SparkSession, sf: str) -> DataFrame:
    from .library import LOGS

    return listings.first_pass(LOGS.df(spark, sf), "id", "log", "len", 0.5)


# ------------------------------------------------------------------ jobs

PROJECTS = Cases("project string, output_dir string, readable boolean", ("/p", None, True), ("/q", "out", True), ("/r", "/abs", True), ("/s", None, False))
WRITERS = Cases("id int, project string, event string", (1, "/p", "e"), (2, "/q", "e"), (3, "/r", "e"), (4, "/s", "e"), (5, "/p", "f"), (6, None, "e"), keys=("id", "project"))
CLAIMS = Cases("project string, event string, relpath string", *((p, "e", "2024/x.mp4") for p in ("/p", "/q", "/r", "/s")), ("/p", "f", None))


@query("SELECT id + 1000 * s_suppkey AS id, CASE id WHEN 1 THEN '/p~' || s_suppkey || '-output/2024/x.mp4' WHEN 2 THEN '/q~' || s_suppkey || '/out/2024/x.mp4' WHEN 3 THEN '/abs/2024/x.mp4' END AS output FROM range(1, 7) r(id), supplier")
def job_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return E.job_outputs(WRITERS.df(spark, sf), PROJECTS.df(spark, sf), CLAIMS.df(spark, sf))


@query("SELECT o_orderpriority AS project, count(DISTINCT CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderkey % 2 = 0 THEN o_custkey END) AS events FROM orders GROUP BY 1")
def analysing_events(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    jobs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("event"), F.when(F.col("o_orderkey") % 2 == 0, "analysis").otherwise("render").alias("kind"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("done").alias("status"))
    return E.analysing(jobs, "project")


SWEPT = Cases("project string, event string, pending boolean, touched timestamp, newest int", *(("p", f"p/{i}", i != 2, "2024-01-01 00:00:00", i) for i in range(1, 7)), ("q", "q/1", True, "2024-01-01 00:00:00", 1), ("r", "r/1", True, "2024-01-05 00:00:00", 1), ("r", "r/2", True, "2024-01-01 00:00:00", 2), ("s", "s/1", True, "2024-01-01 00:00:00", 1), keys=("project", "event"))
SWEEP_JOBS = Cases(
    "id int, project string, event string, kind string, status string, created_at timestamp, started_at timestamp, finished_at timestamp",
    (1, "p", "p/6", "analysis", "running", "2024-01-02 00:00:00", "2024-01-02 00:00:00", None), (2, "q", "q/9", "proxy", "running", "2024-01-02 00:00:00", None, None), (3, "r", "r/1", "analysis", "failed", "2024-01-02 00:00:00", "2024-01-02 00:00:00", None),
    (4, "r", "r/2", "analysis", "cancelled", "2024-01-02 00:00:00", None, None), (5, "s", "s/7", "render", "queued", "2024-01-02 00:00:00", None, None), (6, "p", "p/3", "analysis", "done", "2024-01-02 00:00:00", None, None), keys=("id", "project", "event"),
)


@query(each("SELECT * FROM (VALUES ('p', 'p/5'), ('p', 'p/4'), ('p', 'p/3'), ('r', 'r/1')) v(project, event)", project="string", event="string"))
def swept_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.sweep_step(SWEEP_JOBS.df(spark, sf), SWEPT.df(spark, sf), 3)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def needs_render(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    states = catalog.verdict(o, {"editorial": F.col("o_orderstatus")}, {"editorial": F.when(F.col("o_orderstatus") == "F", "x").otherwise(F.col("o_orderstatus"))}, F.lit(True))
    return catalog.needs_render(states).select("o_orderkey")
