"""Plan transforms by name: each takes and gives a DataFrame, and they are composed in order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
_known: dict[str, Transform] = {}
DEFAULT = ("title_card",)


def register(name: str) -> Callable[[Transform], Transform]:
    """Decorator; the last registration of a name holds."""

    def put(f: Transform) -> Transform:
        _known[name] = f
        return f

    return put


def names(chosen: list[str] | None) -> list[str]:
    """No choice is the default; an empty one is none."""
    return list(DEFAULT) if chosen is None else list(chosen)


def apply(df: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    unknown = [n for n in names(chosen) if n not in _known]
    if unknown:
        raise KeyError(f"unknown transforms: {', '.join(unknown)}")
    return reduce(lambda d, n: d.transform(_known[n]), names(chosen), df)


@register("title_card")
def title_card(segments: DataFrame) -> DataFrame:
    """Adds a card before the first segment of each (event, chapter), placed by a fractional position."""
    first = segments.groupBy("event", "chapter").agg(F.min("pos").alias("pos"))
    cards = first.select("event", "chapter", (F.col("pos") - 0.5).alias("pos"), F.lit("card").alias("kind"))
    return segments.select("event", "chapter", F.col("pos").cast("double").alias("pos"), "kind").unionByName(cards)


@register("overlay")
def overlay(segments: DataFrame) -> DataFrame:
    """Marks source segments for an overlay."""
    return segments.withColumn("kind", F.when(F.col("kind") == "source", "source+overlay").otherwise(F.col("kind")))
