"""Interval algebra on half-open spans [start, end), per key, as window queries. Empty and reversed spans are dropped; null bounds count as empty; a null key is a key like any other. A key's spans are ordered in one task: a key is a clip, or what else has no more spans than a task can sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..session import spread, stored
from .joins import asof_join


def merge_spans(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): overlapping or touching spans joined (gaps and islands: one shuffle and one sort on keys)."""
    return _merged(df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")), keys).select(*keys, "start", "end")


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, start, end, next): merged spans, numbered in each key from 1, and where the next one begins. The last span of an island stands for it, so nothing is grouped."""
    by = _by(keys)
    x = _islands(df, keys).withColumn("_far", F.max("end").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("start").over(by))
    x = x.withColumn("_first", F.last(F.when(F.col("_new") == 1, F.col("start")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return x.filter(F.col("next").isNull() | (F.col("next") > F.col("_far"))).select(*keys, F.col("island").alias("n"), F.col("_first").alias("start"), F.col("_far").alias("end"), "next")


def _by(keys: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("start", "end")


def _islands(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(keys, more, start, end, _new, island): spans with the number of the island that they lie in. They are dealt out over as many tasks as a shuffle has: merged to a few tasks, as small shuffles are, each would sort a large share."""
    reach = F.max("end").over(_by(keys).rowsBetween(W.unboundedPreceding, -1))
    x = spread(df.filter(F.col("start") < F.col("end")).select(*keys, *more, "start", "end"), *keys)
    return x.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("_new").over(_by(keys).rowsBetween(W.unboundedPreceding, 0)))


def clamp(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(start, low), F.least(end, high)


def kept_spans(cuts: DataFrame, extents: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """(keys, start, end): what the cuts leave of [0, length). A key without cuts keeps all of it.

    An empty span at 0 carries a key's lengths. So one sort of cuts and lengths on keys tells what is left behind each run of cuts, the part before the first cut and keys without cuts among it. A cut without an end goes on to the key's.
    """
    zero = F.lit(0).cast(extents.schema[length].dataType)
    c = cuts.select(*keys, F.greatest("start", zero).alias("start"), "end").filter(F.coalesce(F.col("start") < F.col("end"), F.lit(True)))
    heads = extents.groupBy(*keys).agg(F.collect_list(F.struct(F.col(length).alias("len"))).alias("_lengths"))
    at = [F.lit(0).cast(c.schema[f].dataType).alias(f) for f in ("start", "end")]
    both = spread(c.unionByName(heads.select(*keys, *at, "_lengths"), allowMissingColumns=True), *keys)
    by = W.partitionBy(*keys).orderBy("start", F.asc_nulls_last("end"))
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    both = both.select(*keys, F.max("end").over(so_far).alias("start"), F.lead("start").over(by).alias("_next"), F.max(F.col("end").isNull()).over(so_far).alias("_open"), F.last("_lengths", ignorenulls=True).over(so_far).alias("_lengths"))
    left = both.filter(~F.col("_open") & F.coalesce(F.col("_next") > F.col("start"), F.lit(True))).select(*keys, "start", "_next", F.explode("_lengths").alias("l"))
    # least leaves out nulls
    return left.select(*keys, "start", F.least("_next", "l.len").alias("end")).filter(F.col("start") < F.col("end"))


def subtract_spans(spans: DataFrame, blockers: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, start, end): the parts of each span outside the union of its key's blockers.

    Merged blockers are numbered in each key, once, as a table; the gap behind a blocker has its number, the one before all others 0. Two windows over both sides give a span the numbers of the first and the last gap that it may reach, and the gaps between them are looked up by number, so the work grows with the parts that come out and no key's blockers are gathered.
    """
    keep = keep or []
    b = stored(_merged(blockers, keys), "blockers")
    none = F.lit(None).cast(b.schema["end"].dataType)
    gap = lambda n, after, before: (F.lit(0).alias("_t"), n.cast("int").alias("gap"), F.struct(after.alias("after"), before.alias("before")).alias("_gap"))
    gaps = b.select(*keys, *gap(F.col("n"), F.col("end"), F.col("next"))).unionByName(b.filter("n = 1").select(*keys, *gap(F.lit(0), none, F.col("start"))))
    x = spans.filter(F.col("start") < F.col("end")).select(*keys, *keep, "start", "end")
    ends = lambda at, until, n, side: (F.col(at).alias("_at"), F.col(until).alias("_until"), n.cast("int").alias("_n"), F.lit(side).alias("_side"))
    both = x.select("*", *ends("start", "end", F.lit(None), 1)).unionByName(b.select(*keys, *ends("start", "start", F.col("n"), 0)), allowMissingColumns=True)
    begun = lambda *order: F.last("_n", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    x = spread(both, *keys).withColumn("_low", begun("_at", "_side")).withColumn("_high", begun("_until", F.desc("_side"))).filter("_side = 1")
    low, high = F.coalesce("_low", F.lit(0)), F.coalesce("_high", F.lit(0))
    x = x.select(*keys, *keep, "start", "end", F.lit(0).alias("_t"), F.explode(F.sequence(low, F.greatest(low, high))).alias("gap"))
    x = asof_join(x, gaps, [*keys, "gap"], "_t", "_gap")
    # greatest and least leave out nulls
    return x.select(*keys, *keep, F.greatest("start", "_gap.after").alias("start"), F.least("end", "_gap.before").alias("end")).filter(F.col("start") < F.col("end"))


def resolve_priority(spans: DataFrame, keys: list[str], kind: str, strong: list[str]) -> DataFrame:
    """(keys, kind, start, end): strong kinds pass unmerged; others lose what strong ones cover."""
    top = spans.filter(F.col(kind).isin(strong)).select(*keys, kind, "start", "end")
    rest = spans.filter(~F.col(kind).isin(strong))
    return top.unionByName(subtract_spans(rest, top, keys, [kind]))


def measure(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covered): the length of the union, in the spans' own type."""
    return merge_spans(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def overlap_labels(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, start, end, labels): merged spans with the sorted distinct labels of the spans that they are made of, which are those that overlap them by more than an instant. One shuffle on keys."""
    return _islands(df, keys, label).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels")).drop("island")


def cover_state(suggestions: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """suggestions with state: 'cut' if a merged cut contains it, 'partly-cut' if one overlaps it, else 'pending'. Merged cuts are disjoint, so the last one that begins before a suggestion's end decides: one as-of lookup."""
    cols = suggestions.columns
    m = merge_spans(cuts, keys).select(*keys, F.col("start").alias("_t"), F.struct("start", "end").alias("_cut"))
    x = asof_join(suggestions.withColumn("_t", F.col("end")), m, keys, "_t", "_cut", strict=True)
    inside = (F.col("_cut.start") <= F.col("start")) & (F.col("_cut.end") >= F.col("end"))
    return x.select(*cols, F.when(inside, "cut").when(F.col("_cut.end") > F.col("start"), "partly-cut").otherwise("pending").alias("state"))
