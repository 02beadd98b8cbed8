"""Ordered chains of operations, many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where frames lie in the computer's own memory, and the steps that bring them there and away.
SYSTEM, UP, DOWN = "system", "hwupload", "hwdownload"


def transfer(source: Column, target: Column) -> Column:
    """The step that brings frames from one place to another; null if they are there. Between two devices they come down first, and the next step takes them up."""
    return F.when(source.isNull() | target.isNull() | (source == target), None).when(source == SYSTEM, UP).otherwise(DOWN)


def with_transfers(steps: DataFrame, chain: str = "chain", pos: str = "pos") -> DataFrame:
    """(chain, place, op, frames_in, frames_out, inserted): the steps (chain, pos, op, frames_in, frames_out) with a row between two neighbours of which one leaves frames where the next does not take them. Places count from 1 in each chain. One window on chains; a chain's rows are not gathered."""
    x = steps.select(chain, F.col(pos).alias("_pos"), "op", "frames_in", "frames_out").withColumn("_from", F.lag("frames_out").over(W.partitionBy(chain).orderBy("_pos")))
    moved = transfer(F.col("_from"), F.col("frames_in"))
    own = F.struct(F.lit(1).alias("_k"), "op", "frames_in", "frames_out", F.lit(False).alias("inserted"))
    between = F.when(moved.isNotNull(), F.struct(F.lit(0).alias("_k"), moved.alias("op"), F.col("_from").alias("frames_in"), F.col("frames_in").alias("frames_out"), F.lit(True).alias("inserted")))
    x = x.select(chain, "_pos", F.explode(F.array_compact(F.array(between, own))).alias("s")).select(chain, "_pos", "s.*")
    by = W.partitionBy(chain).orderBy("_pos", "_k")
    return x.select(chain, F.row_number().over(by).cast("long").alias("place"), "op", "frames_in", "frames_out", "inserted")
