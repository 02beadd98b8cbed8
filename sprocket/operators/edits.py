"""Edits of documents and jobs as new rows: nothing is changed in place, and a refusal is a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jobs_by_status(jobs: DataFrame, status: str, project: str | None = None, kind: str | None = None) -> DataFrame:
    """Jobs of a status, of one project and kind if asked for. A job without a project belongs to none."""
    x = jobs.filter(F.col("status") == status)
    x = x if project is None else x.filter(F.col("project") == project)
    return x if kind is None else x.filter(F.col("kind") == kind)


def add_clips(refs: DataFrame, added: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(event, chapter, pos, clip, problem): refs with the added clips (event, chapter, clip, n) at the end of their chapters, in order of n. chapters: event, chapter, all that there are, those without clips among them; without it a chapter is there if it has clips. A clip that is there already, or in a chapter that is not, is refused: its pos is null and problem says why."""
    ends = refs.groupBy("event", "chapter").agg(F.max("pos").alias("_end"))
    if chapters is not None:
        ends = chapters.select("event", "chapter").distinct().join(ends, ["event", "chapter"], "left").withColumn("_end", F.coalesce("_end", F.lit(0)))
    known = refs.select("event", "clip", F.lit(True).alias("_known")).distinct()
    x = added.join(ends, ["event", "chapter"], "left").join(known, ["event", "clip"], "left")
    x = x.withColumn("_again", F.row_number().over(W.partitionBy("event", "clip").orderBy("n")) > 1)
    x = x.withColumn("problem", F.when(F.col("_known") | F.col("_again"), "already there").when(F.col("_end").isNull(), "no such chapter"))
    good = F.col("problem").isNull()
    place = F.count_if(good).over(W.partitionBy("event", "chapter").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    x = x.select("event", "chapter", F.when(good, F.col("_end") + place).cast("long").alias("pos"), "clip", "problem")
    return refs.select("event", "chapter", F.col("pos").cast("long").alias("pos"), "clip", F.lit(None).cast("string").alias("problem")).unionByName(x)


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, outcome): what a request to cancel does: a queued job ends, a running one is asked to stop, an ended one stays, and an unknown one is none."""
    s = F.col("status")
    return wanted.join(jobs.select("id", "status"), "id", "left").select("id", F.when(s.isNull(), "unknown").when(s == "queued", "cancelled").when(s == "running", "asked").otherwise("ended").alias("outcome"))


def progressed(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, progress): running jobs with the highest report, kept between 0 and 1; other jobs as they are."""
    r = reports.groupBy("id").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress"))).alias("_p"))
    return jobs.join(r, "id", "left").select("id", F.when((F.col("status") == "running") & F.col("_p").isNotNull(), F.greatest("progress", "_p")).otherwise(F.col("progress")).alias("progress"))


def restore_conflicts(cuts: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    """restored (keys, id, start, end, read) with conflict: whether a cut that is kept overlaps it; two cuts that are both as read never do. One sweep: kept cuts that began before a restored one ends, by the latest end among them."""
    side = lambda df, back: df.select(*keys, "id", "start", "end", "read", F.lit(back).alias("_back"))
    both = side(cuts, False).unionByName(side(restored, True))
    edges = both.withColumn("_t", F.when(F.col("_back"), F.col("end")).otherwise(F.col("start")))
    # at one instant a cut that begins there does not reach the one that ends there
    by = W.partitionBy(*keys).orderBy("_t", F.desc("_back")).rowsBetween(W.unboundedPreceding, 0)
    kept = ~F.col("_back") & (F.col("start") < F.col("end"))
    x = edges.withColumn("_any", F.max(F.when(kept, F.col("end"))).over(by)).withColumn("_new", F.max(F.when(kept & ~F.col("read"), F.col("end"))).over(by))
    reach = F.when(F.col("read"), F.col("_new")).otherwise(F.col("_any"))
    return x.filter("_back").select(*keys, "id", F.coalesce(reach > F.col("start"), F.lit(False)).alias("conflict"))


def tiles_at(points: DataFrame, strips: DataFrame, key: str) -> DataFrame:
    """points (key, at) with tile: the tile of the strip (key, interval, tiles) that shows the time, the first one before its begin and the last one beyond its end."""
    return points.join(strips, key).select(*points.columns, F.greatest(F.lit(0), F.least(F.floor(F.col("at") / F.col("interval")), F.col("tiles") - 1)).cast("long").alias("tile"))


def repeats(ordinals: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(keys, ordinal, n): how often each key frame is shown."""
    return ordinals.groupBy(*keys, ordinal).agg(F.count("*").alias("n"))


def whole_list(times: Column) -> Column:
    """A list of struct(name, start_ms, end_ms); null as a whole if one of them is no name with a stretch of time."""
    good = F.forall(times, lambda t: F.coalesce(t["name"].isNotNull() & (t["start_ms"] >= 0) & (t["end_ms"] >= t["start_ms"]), F.lit(False)))
    return F.when(good, times)


def inserter(rows: Callable[[DataFrame], DataFrame], before: bool) -> Callable[[DataFrame], DataFrame]:
    """A plan transform that adds a row half a place before or after the first or last segment of each chapter; rows makes (event, chapter, kind) of the segments."""

    def put(segments: DataFrame) -> DataFrame:
        at = segments.groupBy("event", "chapter").agg((F.min("pos") - 0.5 if before else F.max("pos") + 0.5).alias("pos"))
        new = rows(segments).join(at, ["event", "chapter"]).select("event", "chapter", "pos", "kind")
        return segments.select("event", "chapter", F.col("pos").cast("double").alias("pos"), "kind").unionByName(new)

    return put


def attacher(overlay: Column, where: Column) -> Callable[[DataFrame], DataFrame]:
    """A plan transform that adds an overlay to the list of those rows for which `where` holds."""
    return lambda segments: segments.withColumn("overlays", F.when(where, F.array_append("overlays", overlay)).otherwise(F.col("overlays")))
