"""Registered queries of the edits, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import movie as M
from ..session import table
from .library import Cases, each
from .queries import query


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7 OR o_orderstatus = 'O' AND o_custkey = 14")
def jobs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey").isin(7, 14), "here").alias("project"), F.lit("render").alias("kind"))
    return E.jobs_by_status(o, "O", "here", "render").select("o_orderkey")


REFS = Cases("event string, chapter string, pos long, clip string", ("a", "", 1, "p"), ("a", "", 2, "q"), ("a", "Dock", 1, "r"))
ADDED = Cases("event string, chapter string, clip string, n int", ("a", "", "s", 1), ("a", "", "p", 2), ("a", "", "t", 3), ("a", "Dock", "s", 4), ("a", "Yard", "u", 5), ("b", "", "p", 6), ("a", "Dock", "v", 7))


_NEW = each("SELECT * FROM (VALUES ('a', '', 3, 's', NULL), ('a', '', NULL, 'p', 'already there'), ('a', '', 4, 't', NULL), ('a', 'Dock', NULL, 's', 'already there'), ('a', 'Yard', NULL, 'u', 'no such chapter'), ('b', '', NULL, 'p', 'no such chapter'), ('a', 'Dock', 2, 'v', NULL)) v(event, chapter, pos, clip, problem)", event="string")


@query(f"SELECT event, chapter, pos, clip, NULL::VARCHAR AS problem FROM {REFS.sql} UNION ALL {_NEW}")
def added_clips(spark: SparkSession, sf: str) -> DataFrame:
    return E.add_clips(REFS.df(spark, sf), ADDED.df(spark, sf))


@query("SELECT i AS id, CASE o_orderstatus WHEN 'F' THEN 'ended' WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'asked' ELSE 'unknown' END AS outcome FROM (SELECT unnest(range(1, 300, 7)) AS i) LEFT JOIN orders ON o_orderkey = i")
def cancelled_jobs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "F", "done").when(s == "O", "queued").otherwise("running").alias("status"))
    return E.cancelled(o, spark.range(1, 300, 7))


RUNNING = Cases("id int, status string, progress double", (1, "running", 0.2), (2, "running", 0.9), (3, "done", 1.0), (4, "queued", 0.0), (5, "running", 0.1))
REPORTS = Cases("id int, progress double", (1, 0.4), (1, 0.3), (2, 0.5), (3, 0.1), (4, 0.7), (5, 1.7), (9, 0.5))


@query(each("SELECT * FROM (VALUES (1, 0.4::DOUBLE), (2, 0.9), (3, 1.0), (4, 0.0), (5, 1.0)) v(id, progress)", id="int"))
def progressed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return E.progressed(RUNNING.df(spark, sf), REPORTS.df(spark, sf))


_CUTS = "x AS (SELECT l_suppkey AS clip, l_orderkey * 10 + l_linenumber AS id, min(l_partkey * 10) AS s, min(l_partkey * 10) + max(CAST(l_quantity AS BIGINT)) * 3 AS e, min(l_tax) > 0.03 AS read, max(l_discount) > 0.08 AS back FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_CUTS} SELECT r.clip, r.id, coalesce(bool_or(c.s < r.e AND c.e > r.s AND NOT (c.read AND r.read)), FALSE) AS conflict FROM (SELECT * FROM x WHERE back) r LEFT JOIN (SELECT * FROM x WHERE NOT back) c ON c.clip = r.clip GROUP BY 1, 2")
def restore_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("clip"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg((F.min("l_partkey") * 10).alias("start"), (F.max("l_quantity").cast("long") * 3).alias("n"), (F.min("l_tax") > 0.03).alias("read"), (F.max("l_discount") > 0.08).alias("back"))
    x = x.withColumn("end", F.col("start") + F.col("n"))
    return E.restore_conflicts(x.filter("not back"), x.filter("back"), ["clip"])


@query("SELECT doc_id, least(doc_id % 500 // greatest(1, CAST(ceil(n_chars / 120.0) AS BIGINT)), 9) AS tile FROM documents")
def tiles_at(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    strips = d.select("doc_id", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 120)).alias("interval"), F.lit(10).alias("tiles"))
    return E.tiles_at(d.select("doc_id", (F.col("doc_id") % 500).alias("at")), strips, "doc_id").select("doc_id", "tile")


@query("SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def frame_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return E.repeats(table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber")


RECORDED = Cases("id int, json string", (1, '[{"name": "x", "start_ms": 0, "end_ms": 5}, {"name": "y", "start_ms": 5, "end_ms": 5}]'), (2, '[{"name": "x", "start_ms": 0, "end_ms": 5}, {"start_ms": 5, "end_ms": 9}]'), (3, "[]"), (4, '[{"name": "x", "start_ms": 7, "end_ms": 5}]'), (5, "junk"), (6, None))


@query(each("SELECT * FROM (VALUES (1, 2), (2, NULL), (3, 0), (4, NULL), (5, NULL), (6, NULL)) v(id, n)", id="int"))
def recorded_chapters(spark: SparkSession, sf: str) -> DataFrame:
    times = E.whole_list(F.from_json("json", "array<struct<name:string,start_ms:bigint,end_ms:bigint>>"))
    return RECORDED.df(spark, sf).withColumn("t", times).select("id", F.when(F.col("t").isNotNull(), F.size("t")).alias("n"))


@query("SELECT conv_id AS event, role AS chapter, CAST(turn AS DOUBLE) AS pos, 'source' AS kind FROM conversations UNION ALL SELECT conv_id, role, max(turn) + 0.5, 'end' FROM conversations GROUP BY 1, 2")
def inserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("event"), F.col("role").alias("chapter"), F.col("turn").alias("pos"), F.lit("source").alias("kind"))
    ends = E.inserter(lambda s: s.select("event", "chapter", F.lit("end").alias("kind")).distinct(), before=False)
    return c.transform(ends)


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'a,logo' ELSE 'a' END AS overlays FROM conversations")
def attached_overlays(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array(F.lit("a")).alias("overlays"))
    return c.transform(E.attacher(F.lit("logo"), F.col("role") == "user")).select("conv_id", "turn", F.array_join("overlays", ",").alias("overlays"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '1:1' ELSE '4:3' END AS sar FROM part")
def square_pixels(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 != 0, "4:3").when(F.col("p_size") % 2 == 0, "0:1")
    return table(spark, sf, "part").select("p_partkey", M.sar(raw).alias("sar"))
