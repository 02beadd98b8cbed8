"""Registered queries of probes, canonical hashes, post-conditions, chains and the events list, over tables derived from the given ones with odd cases among the rows. Each stands beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import chains, checks, listing
from ..session import spread, table
from ..sources import documents as D
from ..sources import probes, sidecars, yaml_text
from . import yamls
from .queries import query


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """(k, json, size): what a probe could say of a file for each part; of ten files four are of no use, and two are not there or empty."""
    k, n = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    when = lambda cond, *parts: F.when(cond, text(*parts)).otherwise("")
    video = text(
        '{"codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p", "sample_aspect_ratio": "0:1", "bit_rate": "N/A", ',
        when(k % 10 != 3, '"width": ', F.when(k % 3 == 0, text('"', n * 16, '"')).otherwise((n * 16).cast("string")), ", "),
        '"height": ', n * 9, ", ",
        F.when(k % 10 == 4, '"avg_frame_rate": "0/0", "r_frame_rate": "1200/1"').when(k % 4 == 0, '"avg_frame_rate": "0/0", "r_frame_rate": "25/1"').otherwise('"avg_frame_rate": "30000/1001", "r_frame_rate": "90000/1"'),
        ', "duration": "', n, '.5"',
        when(k % 9 == 0, ', "color_transfer": "smpte2084"'),
        F.when(k % 7 == 0, ', "tags": {"rotate": "90"}').when(k % 7 == 1, ', "side_data_list": [{"side_data_type": "Other", "rotation": 7}, {"side_data_type": "Display Matrix", "rotation": -90}]').when(k % 7 == 2, ', "tags": {"rotate": "x"}, "side_data_list": [{"side_data_type": "Display Matrix", "rotation": 180}]').otherwise(""),
        "}",
    )
    audio = '{"codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000"}'
    streams = F.array_join(F.array_compact(F.array(F.when(k % 2 == 0, audio), F.when(k % 10 != 2, video))), ", ")
    whole = text('{"streams": [', streams, '], "format": {"duration": ', F.when(k % 8 == 0, '"N/A"').otherwise(text('"', n, '.25"')), ', "bit_rate": "', k * 1000, '"', when(k % 3 == 1, ', "tags": {"creation_time": "2024-01-05T10:00:00.500000Z"}'), "}}")
    json = F.when(k % 10 == 1, F.substring(whole, 1, 40)).otherwise(whole)
    return spread(table(spark, sf, "part"), "p_partkey").select(k.alias("k"), json.alias("json"), F.when(k % 10 == 5, 0).when(k % 10 != 6, k + 1).cast("long").alias("size"))


_PROBLEM = "CASE p_partkey % 10 WHEN 6 THEN 'absent' WHEN 5 THEN 'empty' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no video' WHEN 3 THEN 'no size' WHEN 4 THEN 'no rate' END"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS n, {_PROBLEM} AS problem FROM part), g AS (SELECT * FROM p WHERE problem IS NULL)
SELECT p.k, p.problem, CASE WHEN g.k % 8 = 0 THEN g.n + 0.5::DOUBLE WHEN g.k IS NOT NULL THEN g.n + 0.25::DOUBLE END AS seconds, CASE WHEN g.k % 4 = 0 THEN 25::DOUBLE WHEN g.k IS NOT NULL THEN round(30000::DOUBLE / 1001, 6) END AS fps,
CAST(g.n * 16 AS BIGINT) AS width, CAST(g.n * 9 AS BIGINT) AS height, CASE WHEN g.k % 7 IN (0, 1) THEN 270 WHEN g.k % 7 = 2 THEN 180 END AS rotation, g.k % 9 = 0 AS is_hdr, CASE WHEN g.k % 2 = 0 THEN 2 END AS channels, g.k * 1000 AS video_bitrate,
CASE WHEN g.k % 3 = 1 THEN '2024-01-05 10:00:00.5 +0' END AS created FROM p LEFT JOIN g USING (k)""")
def probed_clips(spark: SparkSession, sf: str) -> DataFrame:
    x = probes.probed(_probes(spark, sf), "json", "size")
    made = F.concat_ws(" ", F.date_format("created.local", "yyyy-MM-dd HH:mm:ss.S"), F.concat(F.lit("+"), F.col("created.offset")))
    return x.select("k", "problem", "seconds", F.round("fps", 6).alias("fps"), "width", "height", "rotation", "is_hdr", F.col("audio.channels").alias("channels"), "video_bitrate", F.when(F.col("created").isNotNull(), made).alias("created"))


@query(f"""WITH p AS (SELECT {_PROBLEM} AS problem FROM part) SELECT coalesce(problem, 'good') AS problem, count(*) AS n, CASE WHEN problem IS NULL THEN count(*) ELSE (SELECT count(problem) FROM p) END AS observed FROM p GROUP BY problem""")
def probe_faults(spark: SparkSession, sf: str) -> DataFrame:
    """One pass writes good rows and quarantined ones, and counts both on the way."""
    good, bad, seen = probes.split(probes.probed(_probes(spark, sf), "json", "size"))
    both = good.select(F.lit("good").alias("problem"), F.lit(seen["good"]).alias("observed")).unionByName(bad.select("problem", F.lit(seen["bad"]).alias("observed")))
    return both.groupBy("problem", "observed").agg(F.count("*").alias("n")).select("problem", "n", F.col("observed").cast("long").alias("observed"))


# ------------------------------------------------------------------ canonical hashes

_QUOTED = r"""'"' || list_aggregate(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN '\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE '\u' || lower(to_hex(55296 + ((unicode(c) - 65536) >> 10))) || '\u' || lower(to_hex(56320 + ((unicode(c) - 65536) & 1023))) END), 'string_agg', '') || '"'"""


@query(f"""SELECT doc_id, sha256('{{"lang": ' || coalesce('"' || lang || '"', 'null') || ', "score": ' || CAST(n_chars / 7::DOUBLE AS VARCHAR) || ', "tags": {{"a": ' || n_chars || ', "é": null}}, "text": ' || {_QUOTED.format("text || chr(128512)").replace("'string_agg', '')", "'string_agg', '')")} || '}}') AS hash FROM documents""".replace('"é"', '"\\u00e9"'))
def canonical_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of a document's fields, its whole text in any script among them."""
    value = F.struct(F.concat("text", F.lit("\U0001f600")).alias("text"), "lang", (F.col("n_chars") / F.lit(7.0)).alias("score"), F.create_map(F.lit("é"), F.lit(None).cast("long"), F.lit("a"), F.col("n_chars")).alias("tags"))
    return table(spark, sf, "documents").select("doc_id", canonical.digest(value, "struct<text:string,lang:string,score:double,tags:map<string,bigint>>").alias("hash"))


@query("""WITH c AS (SELECT DISTINCT conv_id, role, turn FROM conversations WHERE conv_id % 11 IN (0, 9)), r AS (SELECT conv_id, '{"clips": [' || string_agg('"' || role || '/' || turn || '.mp4"', ', ' ORDER BY turn) || '], "name": "' || role || '"}' AS chapter, role FROM c GROUP BY conv_id, role),
d AS (SELECT conv_id AS event, '{"chapters": [' || string_agg(chapter, ', ' ORDER BY role) || '], "clips": {}, "ignore": [], "look": ' || CASE WHEN conv_id % 11 = 9 THEN '{"font": "a", "sizes": [1, 2.5, 16, null, "yes"]}' ELSE '{}' END
|| ', "metadata": {"date": "' || make_date(2024, CAST(conv_id % 12 + 1 AS INTEGER), 7) || '", "description": null, "location": null, "title": "Talk ' || conv_id || '"}, "version": 0}' AS text FROM r GROUP BY conv_id),
s AS (SELECT conv_id AS event, '[' || string_agg('{"identity": "' || role || '/' || turn || '.mp4", "signal": {"mtime_ns": ' || (turn * 1000) || ', "size": ' || conv_id || '}}', ', ' ORDER BY role || '/' || turn || '.mp4') || ']' AS clips FROM c GROUP BY conv_id),
h AS (SELECT event, sha256(d.text) AS editorial, sha256('{"font": "\\u00c5"}') AS defaults, sha256(s.clips) AS clip_set, sha256('{"ffmpeg_version": [7, 1], "render_graph_version": 12}') AS engine FROM d JOIN s USING (event))
SELECT *, sha256('{"clip_set": "' || clip_set || '", "defaults": "' || defaults || '", "editorial": "' || editorial || '", "engine": "' || engine || '"}') AS combined FROM h""")
def event_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of every event with a good document: of what it says, of the defaults, of its clips and of the engine."""
    docs = yaml_text.read_documents(yamls.documents(spark, sf), "text").filter("problem is null")
    signals = D.references(docs, "event").select("event", F.struct(F.col("clip").alias("identity"), F.struct(F.col("event").alias("size"), (F.regexp_extract("clip", r"/(\d+)\.", 1).cast("long") * 1000).alias("mtime_ns")).alias("signal")).alias("c"))
    clips = signals.groupBy("event").agg(F.array_sort(F.collect_list("c")).alias("clips"))
    x = docs.join(clips, "event").withColumn("look", sidecars.canonical_text(F.col("doc.look")))
    defaults = sidecars.canonical_text(F.lit('{"font": "Å"}'))
    return x.select("event", canonical.fingerprint(canonical.editorial(F.col("doc"), F.col("look")), defaults, F.col("clips"), 12, (7, 1)).alias("f")).select("event", "f.*")


@query(r"""SELECT doc_id, sha256('["' || source || ' \u65e5 \ud83d\ude00 \"x\".mp4", ' || n_chars || ', ' || doc_id || ', ' || CAST(n_chars / 1000::DOUBLE AS VARCHAR) || ', [320, 180], 2]') AS thumbnail,
sha256('["poster", "' || source || ' \u65e5 \ud83d\ude00 \"x\".mp4", ' || n_chars || ', ' || doc_id || ', ' || CAST(n_chars / 8::DOUBLE AS VARCHAR) || ', ' || CASE WHEN doc_id % 2 = 0 THEN '90' ELSE 'null' END || ', [640, 360], 1]') AS poster FROM documents""")
def derivative_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of pictures made of a clip whose name is in several scripts and holds quotes."""
    name, n, i = F.concat("source", F.lit(' 日 \U0001f600 "x".mp4')), F.col("n_chars"), F.col("doc_id")
    box = lambda *sides: (F.array(*map(F.lit, sides)), "array<int>")
    turn = F.when(i % 2 == 0, 90)
    return table(spark, sf, "documents").select("doc_id", canonical.file_key(name, n, i, (n / 1000, "double"), box(320, 180), 2).alias("thumbnail"), canonical.file_key(name, n, i, (F.bround(n / 8, 3), "double"), (turn, "int"), box(640, 360), 1, first="poster").alias("poster"))


# ------------------------------------------------------------------ post-conditions, chains, the list

@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 'video streams' WHEN l_partkey % 13 = 0 THEN 'video codec' WHEN l_linenumber = 7 THEN 'dimensions' WHEN l_suppkey % 9 = 0 THEN 'pixel aspect ratio'
WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'audio streams' WHEN l_returnflag <> 'R' AND l_linenumber = 3 THEN 'audio channels' WHEN NOT coalesce(abs(l_quantity + l_discount - 0.03::DOUBLE - l_quantity) <= 0.05::DOUBLE + 1e-9, FALSE) THEN 'video duration'
WHEN l_linenumber = 5 THEN 'packet count' WHEN l_linestatus = 'F' AND l_partkey % 5 = 0 THEN 'video frames' END AS rule, CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_linenumber = 7 THEN '960xnone' END AS found FROM lineitem""")
def broken_proxies(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    sound = c("l_returnflag") != "R"
    facts: dict[str, Column] = {
        "n_video": F.when(c("l_partkey") % 11 == 0, 2).otherwise(1), "video_codec": F.when(c("l_partkey") % 13 == 0, "hevc").otherwise("h264"), "pix_fmt": F.lit("yuv420p"), "width": F.lit(960), "height": F.when(c("l_linenumber") != 7, 540),
        "sar": F.when(c("l_suppkey") % 9 == 0, "4:3").when(c("l_suppkey") % 9 != 1, "0:1"), "n_audio": F.when(sound | (c("l_linenumber") == 1), 1).otherwise(0), "audio_codec": F.lit("aac"), "channels": F.when(c("l_linenumber") == 3, 1).otherwise(2),
        "seconds": c("l_quantity") + c("l_discount") - 0.03, "packets": F.when(c("l_linenumber") != 5, c("l_partkey")), "want_width": F.lit(960), "want_height": F.lit(540), "want_seconds": c("l_quantity"), "want_audio": sound,
        "want_frames": F.when(c("l_linestatus") == "F", F.when(c("l_partkey") % 5 == 0, c("l_partkey") + 1).otherwise(c("l_partkey"))),
    }
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(v.alias(k) for k, v in facts.items()))
    return checks.proxies(x).select("l_orderkey", "l_linenumber", "l_partkey", "broken.rule", F.when(F.col("broken.rule") == "dimensions", F.col("broken.found")).alias("found"))


_PLACE = "CASE (turn * 7 + conv_id) % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'vaapi' WHEN 2 THEN 'cuda' ELSE 'vaapi' END"


@query(f"""WITH s AS (SELECT DISTINCT conv_id AS chain, turn AS pos, {_PLACE} AS frames_in, CASE WHEN turn % 3 = 0 THEN {_PLACE} ELSE 'system' END AS frames_out FROM conversations),
l AS (SELECT *, lag(frames_out) OVER (PARTITION BY chain ORDER BY pos) AS before FROM s),
u AS (SELECT chain, pos, 1 AS k, 'op' || pos AS op, frames_in, frames_out, FALSE AS inserted FROM l UNION ALL SELECT chain, pos, 0, CASE WHEN before = 'system' THEN 'hwupload' ELSE 'hwdownload' END, before, frames_in, TRUE FROM l WHERE before <> frames_in)
SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY pos, k) AS place, op, frames_in, frames_out, inserted FROM u""")
def transferred_chains(spark: SparkSession, sf: str) -> DataFrame:
    place = F.expr(_PLACE)
    c = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    steps = c.select(F.col("conv_id").alias("chain"), F.col("turn").alias("pos"), F.concat(F.lit("op"), "turn").alias("op"), place.alias("frames_in"), F.when(F.col("turn") % 3 == 0, place).otherwise("system").alias("frames_out"))
    return chains.with_transfers(steps)


@query("""WITH t AS (SELECT DISTINCT conv_id AS event, turn AS clip FROM conversations), e AS (SELECT DISTINCT event, CASE WHEN event % 13 = 5 THEN 'EACCES' END AS fault, CASE WHEN event % 17 = 3 THEN 'no date' END AS meta, CASE WHEN event % 7 = 2 THEN 'duplicate clip' END AS problem FROM t),
x AS (SELECT *, clip % 5 <> 4 AS disk, clip % 4 <> 3 AS ref, clip % 8 = 3 AS ign, clip % 6 = 0 AS exc FROM t),
n AS (SELECT event, count(*) FILTER (ref OR (disk AND NOT ign)) AS n_clips, count(*) FILTER (disk AND NOT ref AND ign) AS n_ignored, count(*) FILTER (disk AND NOT ref AND NOT ign) AS n_new, count(*) FILTER (ref AND NOT disk) AS n_missing, count(*) FILTER (ref AND NOT disk AND NOT exc) AS n_blocking FROM x GROUP BY event),
j AS (SELECT o_custkey AS event, o_orderkey AS job_id, o_orderstatus AS job_status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
f AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'unreadable disk' WHEN meta IS NOT NULL THEN 'unusable metadata' WHEN problem IS NOT NULL THEN 'unparseable document' END AS failure FROM e)
SELECT f.event, CASE WHEN failure IS NULL THEN 'event' ELSE 'error' END AS kind, failure, coalesce(fault, meta, problem) AS detail, CASE WHEN failure IS NULL AND f.event % 3 <> 0 THEN 'Talk ' || f.event END AS title,
CASE WHEN failure IS NULL THEN n_clips END AS n_clips, CASE WHEN failure IS NULL THEN n_ignored END AS n_ignored, CASE WHEN failure IS NULL THEN n_new END AS n_new, CASE WHEN failure IS NULL THEN n_missing END AS n_missing, CASE WHEN failure IS NULL THEN n_blocking END AS n_blocking,
CASE WHEN failure IS NULL THEN job_id END AS job_id, CASE WHEN failure IS NULL THEN job_status END AS job_status, CASE WHEN failure IS NULL THEN f.event % 2 = 1 END AS stale FROM f LEFT JOIN n USING (event) LEFT JOIN j USING (event)""")
def event_list(spark: SparkSession, sf: str) -> DataFrame:
    """All events, those that cannot be read as rows with a cause."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("event"), F.col("turn").alias("clip")).distinct()
    e, k = t.select("event").distinct(), F.col("clip")
    null = F.lit(None).cast("string")
    events = e.select("event", F.when(F.col("event") % 13 == 5, "EACCES").alias("fault"), F.when(F.col("event") % 17 == 3, "no date").alias("metadata_problem"))
    docs = e.filter("event % 3 <> 0 or event % 7 = 2").select("event", F.when(F.col("event") % 7 == 2, "duplicate clip").alias("problem"), F.when(F.col("event") % 3 != 0, F.concat(F.lit("Talk "), "event")).alias("title"), null.cast("date").alias("date"), null.alias("location"))
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    verdicts = e.select("event", (F.col("event") % 2 == 1).alias("stale"), F.array(F.lit("editorial")).alias("reasons"))
    rows = listing.event_rows(events, t.filter(k % 5 != 4), docs, t.filter(k % 4 != 3), t.filter(k % 8 == 3), t.filter(k % 6 == 0), jobs, verdicts)
    return rows.drop("date", "location", "reasons")
