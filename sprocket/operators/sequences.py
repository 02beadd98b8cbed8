"""Ordered sequences: prefix sums, run lengths, running extremes, moved rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def bounds(df: DataFrame, keys: list[str], order: list[str], length: Column) -> DataFrame:
    """df with start_ms and end_ms: each length is rounded (half to even) before it is summed, so that a start is the previous end."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_ms", F.bround(length).cast("long")).withColumn("end_ms", F.sum("_ms").over(by))
    return x.withColumn("start_ms", F.col("end_ms") - F.col("_ms")).drop("_ms")


def bands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, band, first, last, n): runs of equal neighbours (null equals null)."""
    by = W.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1))
    x = x.withColumn("band", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys, value, "band").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def rising(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that raise the high-water mark of value."""
    high = F.max(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_high", high).filter(F.col("_high").isNull() | (F.col(value) > F.col("_high"))).drop("_high")


def first_by(df: DataFrame, keys: list[str], priority: Column, order: list[str]) -> DataFrame:
    """The first row of each key by priority, then order (a title clip, a card's anchor)."""
    w = W.partitionBy(*keys).orderBy(priority, *order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fold(df: DataFrame, keys: list[str], start: Callable[[], Any], step: Callable[[Any, list], Any], finish: Callable[[Any], tuple], result: list[T.StructField]) -> DataFrame:
    """(keys, result): a fold over each key's rows in the order of the other columns. Sorted rows stream through; of a key only its state is held."""
    rest = [c for c in df.columns if c not in keys]
    schema = T.StructType([*(df.schema[k] for k in keys), *result])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != row[: len(keys)]:
                    if key is not None:
                        done.append((*key, *finish(state)))
                    key, state = row[: len(keys)], start()
                state = step(state, row[len(keys) :])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *finish(state)), arrow, strict=True)], schema=arrow)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *rest).mapInArrow(run, schema)


def ordered_hash(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """(keys, digest): SHA-256 of the rows in their own order, whatever order they came in."""
    row = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("\\N")) for p in parts))

    def step(h: Any, row: list) -> Any:
        if h is None:
            h = hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(row[0].encode("utf-8", "surrogatepass"))
        return h

    return fold(df.select(*keys, row.alias("_row")), keys, lambda: None, step, lambda h: (h.hexdigest(),), [T.StructField("digest", T.StringType())])


def kept_in_order(ranks: list[int], weights: list[float], late: bool = False) -> list[bool]:
    """The heaviest increasing run of ranks: those that count as not moved. Ties keep the run found first; if late, the one of fewest rows, and of those the one whose last row comes latest, then the row before it and so on, but the first row earliest. Rows without a weight (NaN) are in no run. n log n: a tree of the best run that ends at or below each rank."""
    place = {r: i + 1 for i, r in enumerate(sorted(set(ranks)))}
    none = (0.0, 1, 0, -1)
    tree: list[tuple[float, int, int, int]] = [none] * (len(place) + 1)  # weight, minus the rows if they matter, order, the row that ends the run
    back: list[int] = []
    size: list[int] = []
    top = (-math.inf, 0, 0, -1)
    for i, r in enumerate(ranks):
        if math.isnan(weights[i]):
            back.append(-1)
            size.append(0)
            continue
        at, best = place[r] - 1, none
        while at:
            best = max(best, tree[at])
            at &= at - 1
        back.append(best[3])
        size.append(1 if best[3] < 0 else size[best[3]] + 1)
        mine, at = (best[0] + weights[i], -size[i] if late else 0, i if late and size[i] > 1 else -i, i), place[r]
        top = max(top, mine)
        while at < len(tree):
            tree[at] = max(tree[at], mine)
            at += at & -at
    out = [False] * len(ranks)
    at = top[3]
    while at >= 0:
        out[at] = True
        at = back[at]
    return out


def moved(df: DataFrame, key: str, before: str, after: str, weight: str, late: bool = False) -> DataFrame:
    """df with moved: false for the heaviest set of rows of a key whose order did not change (late: see `kept_in_order`); null for a key none of whose rows has a weight. One key's rows, an event's clips, go to one call."""
    schema = T.StructType([*df.schema.fields, T.StructField("moved", T.BooleanType())])

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([after, before], kind="stable")
        if rows[weight].isna().all():
            return rows.assign(moved=None)
        return rows.assign(moved=[not k for k in kept_in_order(rows[before].tolist(), rows[weight].tolist(), late)])

    return df.groupBy(key).applyInPandas(mark, schema)


def moved_by_hand(df: DataFrame, key: str, clip: str, before: str, after: str, last: DataFrame | None = None) -> DataFrame:
    """df with moved: false for a largest set of a key's rows whose order did not change; of several such sets one with the most rows in their old places, and of those one without the row moved last. last: key, clip. The three wishes are digits of one weight, to the base of the key's number of rows."""
    place = lambda c: F.row_number().over(W.partitionBy(key).orderBy(c))
    x = df if last is None else df.join(last.select(key, clip, F.lit(True).alias("_last")).distinct(), [key, clip], "left")
    base = F.count("*").over(W.partitionBy(key)) + 1
    latest = F.lit(False) if last is None else F.coalesce("_last", F.lit(False))
    x = x.withColumn("_weight", base * base + F.when(place(before) == place(after), base).otherwise(0) + F.when(latest, 0).otherwise(1))
    return moved(x, key, before, after, "_weight").select(*df.columns, "moved")


#: The weight of the newest rate, and when an estimate is trusted.
ALPHA, MIN_PROGRESS, MIN_OBSERVATIONS = 0.3, 0.05, 3


def eta(df: DataFrame, key: str, at: str, progress: str) -> DataFrame:
    """(key, rate, observations, shown): the weighted rate of progress, and the time left as it is shown, which never rises. progress is a share of 1.

    A fold over the key's sorted observations: lower progress starts anew; equal progress, or a time that does not advance, changes nothing. shown is null until there are three observations and more than 5 % are done. Observations without a time or progress are left out.
    """
    x = df.select(key, F.col(at).cast("double").alias("_t"), F.col(progress).cast("double").alias("_p")).filter("_t is not null and _p is not null and not isnan(_p)")

    def step(state: tuple | None, row: list) -> tuple:
        t1, p1 = row
        if state is None or p1 < state[1]:
            return t1, p1, None, 1, None
        t, p, rate, n, shown = state
        if p1 == p or t1 <= t:
            return state
        now = (p1 - p) / (t1 - t)
        rate = now if rate is None else ALPHA * now + (1 - ALPHA) * rate
        left = (1 - p1) / rate
        trusted = p1 > MIN_PROGRESS and n + 1 >= MIN_OBSERVATIONS
        return t1, p1, rate, n + 1, (left if shown is None else min(shown, left)) if trusted else None

    result = [T.StructField("rate", T.DoubleType()), T.StructField("observations", T.IntegerType()), T.StructField("shown", T.DoubleType())]
    return fold(x, [key], lambda: None, step, lambda s: s[2:], result)
