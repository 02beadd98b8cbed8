"""Joins of a media catalog: reconciliation, as-of and range lookups, collisions, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..session import spread

#: Claims of one path whose rows are made together.
PIECE = 500


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null is equal to null; the keys come once, from the left side."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    x = left.join(r, on, how)
    return x if how in ("left_anti", "left_semi") else x.drop(*(f"_r_{k}" for k in keys))


def reconcile(disk: DataFrame, document: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """(key, status): a full outer join of what lies on disk with what the document refers to. A reference outranks an ignore."""
    d, r, i = disk.select(key).distinct().withColumn("on_disk", F.lit(True)), document.select(key).distinct().withColumn("referenced", F.lit(True)), ignored.select(key).distinct().withColumn("ignored", F.lit(True))
    x = d.join(r, key, "full_outer").join(i, key, "left")
    status = F.when(F.col("on_disk") & F.col("referenced"), "active").when(F.col("referenced"), "missing").when(F.col("ignored"), "ignored").otherwise("new")
    return x.select(key, status.alias("status"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Filters on rows belong before it, as they change which row is latest."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, first_if_none: bool = False, strict: bool = False) -> DataFrame:
    """left with value: the latest of right at or before `at` (strict: before it), null (or the key's first) if there is none. Both sides go through one window on keys, dealt out over as many tasks as a shuffle has, so a row never meets another side's whole history."""
    cols = left.columns
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    both = spread(both, *keys)
    by = W.partitionBy(*keys).orderBy(at, F.desc("_side") if strict else F.asc("_side"))
    both = both.withColumn("_last", F.last("_v", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    if first_if_none:
        both = both.withColumn("_last", F.coalesce("_last", F.first("_v", ignorenulls=True).over(by.rowsBetween(W.currentRow, W.unboundedFollowing))))
    return both.filter("_side = 1").select(*cols, F.col("_last").alias(value))


def range_lookup(points: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, label: str) -> DataFrame:
    """points with the label of the row of starts whose extent, up to the next start, holds the point: an as-of join on sorted starts."""
    return asof_join(points, starts.withColumnRenamed(start, at), keys, at, label)


def collisions(claims: DataFrame, claim: str, path: Column) -> DataFrame:
    """(claim, folded, others): claims that share a folded path, each with the sorted other claims. Singletons are absent. What comes out of a group grows with its square, so groups are dealt out over all tasks of a shuffle, and then again in pieces of their claims: no task makes all that comes out of a large group."""
    x = spread(claims.select(F.col(claim).alias("claim"), path.alias("folded")), "folded")
    groups = x.groupBy("folded").agg(F.sort_array(F.collect_set("claim")).alias("all")).filter(F.size("all") > 1)
    pieces = groups.select("folded", "all", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(PIECE))).alias("_at"))
    some = F.slice("all", F.col("_at"), F.lit(PIECE))
    return spread(pieces, "folded", "_at").select(F.explode(some).alias("claim"), "folded", "all").select("claim", "folded", F.array_join(F.array_remove("all", F.col("claim")), ",").alias("others"))


def twins(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose key another row has, too."""
    x = df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    return x.join(x.groupBy(*names).count().filter("count > 1").drop("count"), names, "left_semi").drop(*names)


def missing(referenced: DataFrame, disk: DataFrame, key: str, excluded: Column | None = None) -> DataFrame:
    """References that are not on disk; excluded ones do not count."""
    rows = referenced if excluded is None else referenced.filter(~F.coalesce(excluded, F.lit(False)))
    return rows.join(disk.select(key), key, "left_anti")


def prunable(history: DataFrame, on_disk: DataFrame, claimed: DataFrame, event: str = "event") -> DataFrame:
    """(event, path): superseded movies that may go.

    history: event, output, superseded (array); on_disk: path; claimed: event, path, what other events record or expect. Paths compare folded. An event whose current movie is not on disk keeps its old ones, which are still its movies; a path that is current or that another event claims stays.
    """
    files = on_disk.select(F.col("path").alias("path"), fold("path").alias("_k"))
    # the current name is folded before the old ones are taken apart
    h = history.select(event, fold("output").alias("_now"), "superseded").select(event, "_now", F.explode("superseded").alias("_old")).withColumn("_k", fold("_old"))
    h = h.join(files.select(F.col("_k").alias("_now")).distinct(), "_now", "left_semi").filter("_k <> _now").join(files, "_k")
    other = claimed.select(F.col(event).alias("_by"), fold("path").alias("_k"))
    mine, theirs = h.alias("m"), other.alias("o")
    x = mine.join(theirs, (F.col("m._k") == F.col("o._k")) & (F.col(f"m.{event}") != F.col("o._by")), "left_anti")
    return x.groupBy("_k").agg(F.min(event).alias(event), F.min("path").alias("path")).select(event, "path")


def incremental(listing: DataFrame, done: DataFrame, key: str, signal: str) -> DataFrame:
    """Rows whose (key, signal) has no result yet: what an analysis has to do."""
    return listing.join(done.select(key, signal), [key, signal], "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed, null-safe on the compared columns."""
    b, a = before.select(key, F.struct(*columns).alias("_b")), after.select(key, F.struct(*columns).alias("_a"))
    x = b.join(a, key, "full_outer")
    return x.select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").alias("change")).filter("change is not null")
