"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches. Labels go along links and are then followed to their own labels, so a path of n nodes takes about log n rounds. Every round is a written table."""
    both = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).filter("x <> y").distinct(), "links")
    # the first round needs no join
    now = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "node"), "labels")
    while True:
        label = now.select(F.col("node").alias("y"), F.col("comp").alias("ly"))
        near = both.join(label, "y").groupBy("x").agg(F.min("ly").alias("m"))
        step = now.join(near, now["node"] == near["x"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        new = written(step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("comp")), "labels")
        now = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return now
