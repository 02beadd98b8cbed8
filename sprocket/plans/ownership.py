"""Registered queries of claims and of old movies that may go, over a movie for each order. Each stands beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from ..session import table
from .queries import query

# an order is a version of its customer's movie; every third name is dated and lies in a year folder, every fifth has a letter beyond ASCII
_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN '2024-05-01 - ' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'Ä' ELSE 'm' END || o_orderkey || '.mp4'"
_PLACE = f"CASE WHEN o_orderkey % 3 = 0 THEN '2024/' ELSE '' END || {_NAME}"
_POSTER = f"replace({_PLACE}, '.mp4', '-poster.jpg')"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("k"), F.expr(_NAME).alias("name"), F.expr(_PLACE).alias("place"), F.expr(_POSTER).alias("poster_place"))


def _manifests(v: DataFrame) -> DataFrame:
    """The newest is the movie, the others are what it took the place of; every seventh manifest records no poster, every thirteenth a name with a folder."""
    m = v.groupBy("event").agg(F.max_by("name", "k").alias("output"), F.max("k").alias("now"), F.collect_list("name").alias("superseded"))
    poster = F.when(F.col("event") % 7 != 0, F.regexp_replace("output", r"\.mp4$", "-poster.jpg"))
    return m.select("event", F.when(F.col("event") % 13 == 0, F.concat(F.lit("x/"), "output")).otherwise(F.col("output")).alias("output"), "superseded", poster.alias("poster"))


_OWN = f"""v AS (SELECT o_custkey AS event, o_orderkey AS k, {_NAME} AS name, {_PLACE} AS place, {_POSTER} AS poster_place FROM orders),
n AS (SELECT event, max(k) AS now FROM v GROUP BY event), m AS (SELECT n.event, now, place, poster_place FROM n JOIN v ON v.k = n.now AND v.event = n.event)"""


@query(f"""WITH {_OWN} SELECT event, path, poster FROM (SELECT v.event, v.place AS path, CASE WHEN v.k % 8 = 0 THEN v.poster_place END AS poster FROM v JOIN m USING (event) WHERE event % 13 <> 0 AND v.k <> m.now AND v.k % 10 <> 4 AND m.now % 10 <> 4 AND v.k % 12 <> 1
AND v.k % 9 <> 2 AND NOT (v.k % 6 = 5 AND m.now % 6 = 5))""")
def prunable_movies(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth file is not there, every twelfth lies outside, every ninth is expected by another event, and old and current movies of one remainder are one file; a poster is there for every eighth movie."""
    v = _versions(spark, sf)
    # all versions of a customer that leave the remainder 5 by 6 are names of one file
    same = F.when(F.col("k") % 6 == 5, F.concat(F.lit("one-"), "event")).otherwise(F.col("place"))
    movies = v.filter("k % 10 <> 4").select(F.col("place").alias("path"), F.lit(True).alias("regular"), (F.col("k") % 12 != 1).alias("inside"), same.alias("file"))
    posters = v.filter("k % 8 = 0").select(F.col("poster_place").alias("path"), F.lit(True).alias("regular"), F.lit(True).alias("inside"), F.lit(None).cast("string").alias("file"))
    expected = v.filter("k % 9 = 2").select((F.col("event") + 1).alias("event"), F.upper("place").alias("path")).unionByName(v.filter("k % 9 = 3").select("event", F.col("place").alias("path")))
    return claims.prunable(_manifests(v), movies.unionByName(posters), expected).select("event", "path", "poster")


@query(f"""WITH {_OWN}, t AS (SELECT event + 1 AS event, place AS path, k FROM v WHERE k % 2 = 0), d AS (SELECT place AS file FROM v WHERE k % 4 <> 2 UNION SELECT poster_place FROM v WHERE k % 3 = 1),
c AS (SELECT t.event, t.path, m.event AS who FROM t JOIN m ON m.place = t.path WHERE m.event % 13 <> 0 AND t.path IN (SELECT file FROM d) UNION SELECT t.event, t.path, m.event FROM t JOIN m ON m.poster_place = replace(t.path, '.mp4', '-poster.jpg') WHERE m.event % 7 <> 0 AND m.poster_place IN (SELECT file FROM d))
SELECT event, path, string_agg(DISTINCT CAST(who AS VARCHAR), ',' ORDER BY CAST(who AS VARCHAR)) AS by FROM c GROUP BY event, path""")
def claimed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events about to write where their neighbour's movies are: the movie or its poster may be the neighbour's."""
    v = _versions(spark, sf)
    targets = v.filter("k % 2 = 0").select((F.col("event") + 1).alias("event"), F.col("place").alias("path"))
    disk = v.filter("k % 4 <> 2").select(F.col("place").alias("path")).unionByName(v.filter("k % 3 = 1").select(F.col("poster_place").alias("path")))
    x = claims.claimed(targets, _manifests(v), disk.withColumn("regular", F.lit(True)))
    return x.select("event", "path", F.array_join(F.transform("by", lambda b: b.cast("string")), ",").alias("by"))
