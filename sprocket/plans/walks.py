"""Registered queries of the folder source: trees that Spark writes from given tables, walked again, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library
from ..session import shared_folder, spread, stored, table
from ..sources import folders
from .queries import query


#: Tasks that walk a year where few years are read, however many events they have.
PARTS = 8


def _tree(spark: SparkSession, sf: str) -> str:
    """A library of a folder for each customer, below years by nation: clips in the folder, in a chapter, among originals and in a chapter to be ignored, files that are none, folders to be ignored, links to events and to nothing. Equal files are one with many names, as a file system may have fewer inodes than a large library has files. Returns its path."""
    k = F.col("c_custkey")
    event = F.concat(F.lit(1990) + F.col("c_nationkey"), F.lit("/event "), k)
    kinds = [
        (F.lit(True), "/a1.MP4", F.repeat(F.lit("x"), (k % 7).cast("int"))),
        (k % 3 == 0, "/Evening/b.mov", F.lit("yy")),
        (k % 5 == 0, "/Original/c.mp4", F.lit("zz")),
        (k % 4 == 0, "/Skipped/d.mkv", F.lit("d")),
        (k % 4 == 0, "/Skipped/.reelignore", F.lit("")),
        (k % 6 == 0, "/notes.txt", F.lit("text")),
        (k % 11 == 0, "/.reelignore", F.lit("")),
        (k % 13 == 0, "/gone.avi", F.lit("-> nothing here")),
        (k % 17 == 0, "/Evening/deep/e.mp4", F.lit("e")),
    ]
    files = F.array_compact(F.array(*(F.when(when, F.struct(F.concat(event, F.lit(name)).alias("path"), content.alias("content"))) for when, name, content in kinds)))
    # an alias of every nineteenth event, in a year after all others
    alias = F.when(k % 19 == 0, F.struct(F.concat(F.lit("2099/again "), k).alias("path"), F.concat(F.lit("-> ../"), event).alias("content")))
    rows = spread(table(spark, sf, "customer"), "c_custkey").select(F.explode(F.array_compact(F.concat(files, F.array(alias)))).alias("f")).select("f.*", F.lit(True).alias("shared"))
    root = shared_folder(spark, "library")
    folders.write_tree(rows, root).agg(F.sum("n")).collect()  # a number
    folders.register(spark)
    return root


_CUSTOMERS = "c AS (SELECT c_custkey AS k, CAST(1990 + c_nationkey AS VARCHAR) AS year, (1990 + c_nationkey) || '/event ' || c_custkey AS event FROM customer)"


@query(f"""WITH {_CUSTOMERS} SELECT year, event, '' AS chapter, 'a1.MP4' AS clip, k % 7 AS size FROM c WHERE year IN ('1995', '2001') AND k % 11 <> 0
UNION ALL SELECT year, event, 'Evening', 'Evening/b.mov', 2 FROM c WHERE year IN ('1995', '2001') AND k % 11 <> 0 AND k % 3 = 0""")
def walked_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The clips of two years' events: the filter on the year reaches the source, whose other years stay unread. One walk serves events and clips."""
    rows = stored(spark.read.format(folders.NAME).option("parts", PARTS).load(_tree(spark, sf)).filter(F.col("year").isin("1995", "2001")), "walk")
    events = library.list_events(folders.events(rows)).select(F.col("path").alias("event"))
    return folders.clips(rows).join(events, "event", "left_semi").select("year", "event", "chapter", "clip", "size")


@query(f"WITH {_CUSTOMERS} SELECT event AS path, year FROM c WHERE k % 11 <> 0")
def walked_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once: those marked go, and of an event and its alias the one that no link leads to stays."""
    rows = spark.read.format(folders.NAME).load(_tree(spark, sf))
    return library.list_events(folders.events(rows)).select("path", "year")


@query(f"""WITH {_CUSTOMERS}, p AS (SELECT event, unnest(['a1.MP4', 'gone.avi', 'Evening', 'a1.MP4/below', 'notes.txt']) AS name, k FROM c)
SELECT event, name, CASE WHEN name = 'a1.MP4' OR (name = 'Evening' AND (k % 3 = 0 OR k % 17 = 0)) OR (name = 'notes.txt' AND k % 6 = 0) THEN 'present' ELSE 'absent' END AS status,
CASE WHEN name = 'a1.MP4' OR (name = 'notes.txt' AND k % 6 = 0) THEN TRUE WHEN name = 'Evening' AND (k % 3 = 0 OR k % 17 = 0) THEN FALSE END AS is_file FROM p""")
def strict_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a look at single paths says: there, or nothing there (no entry, a parent that is a file, a link to nothing)."""
    root = _tree(spark, sf).removeprefix("file://")
    events = spread(table(spark, sf, "customer"), "c_custkey").select(F.concat(F.lit(1990) + F.col("c_nationkey"), F.lit("/event "), F.col("c_custkey")).alias("event"))
    paths = events.select("event", F.explode(F.array(*map(F.lit, ("a1.MP4", "gone.avi", "Evening", "a1.MP4/below", "notes.txt")))).alias("name")).withColumn("path", F.concat_ws("/", F.lit(root), "event", "name"))
    return folders.stats(paths).select("event", "name", "status", "is_file")
