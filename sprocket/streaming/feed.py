"""Watermarked change feed over job versions: (id, status, progress, at)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder
from ..sources.commits import Log

logger = logging.getLogger(__name__)

ENDED = ("done", "failed", "cancelled")


def finished(stream: DataFrame, overlap: str = "30 seconds") -> DataFrame:
    """Each ending once, however often it is read again within the overlap."""
    return stream.filter(F.col("status").isin(*ENDED)).withWatermark("at", overlap).dropDuplicatesWithinWatermark(["id", "status"])


def merged(stream: DataFrame, overlap: str = "30 seconds") -> DataFrame:
    """(id, status, progress, at): versions as they count. An ending is never replaced; otherwise the incoming version holds, even an older one. Rows that change nothing give none."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        out = []
        for part in rows:
            for r in part.sort_values("at", kind="stable").itertuples(index=False):
                new = (r.status, float(r.progress))
                if now is None or (now[0] not in ENDED and new != tuple(now)):
                    now = new
                    out.append((key[0], *new, r.at))
        if now is not None:
            state.update(now)
        if out:
            yield pd.DataFrame(out, columns=["id", "status", "progress", "at"])

    return stream.withWatermark("at", overlap).groupBy("id").applyInPandasWithState(step, "id long, status string, progress double, at timestamp", "status string, progress double", "update", "NoTimeout")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type in windows of event time; later rows than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")


def files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that arrive at a path, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


SNAPSHOT = "id long, status string, progress double, at timestamp"


class Follow(StatefulProcessor):
    """What a subscriber has been told of each job: it starts as the snapshot it was given, says each change once, and forgets a job that has ended after the overlap, when no late row of it can come any more."""

    def __init__(self, overlap_ms: int):
        self.overlap_ms = overlap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "status string, progress double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for r in initialState.itertuples(index=False):
            self.told.update((r.status, float(r.progress)))
            if r.status in ENDED:
                self._forget_after(r.at)

    def _forget_after(self, at: pd.Timestamp) -> None:
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.overlap_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self.told.get() if self.told.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            new = (r.status, float(r.progress))
            if now is None or (now[0] not in ENDED and new != tuple(now)):
                now = new
                out.append((key[0], *new, r.at))
                if r.status in ENDED:
                    self._forget_after(r.at)
        if out:
            self.told.update(now)
            yield pd.DataFrame(out, columns=["id", "status", "progress", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.told.clear()
        return iter(())

    def close(self) -> None:
        pass


def deltas(stream: DataFrame, snapshot: DataFrame, overlap: str = "30 seconds") -> DataFrame:
    """(id, status, progress, at): changes after a snapshot (id, status, progress, at), each once; an ending is never replaced. A job's state goes once the watermark has passed its ending by the overlap, so the state is bounded by the jobs that are active or have ended lately; rows of it that come later still are late and drop."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = int(pd.Timedelta(overlap).total_seconds() * 1000)
    kept = snapshot.select("id", "status", F.col("progress").cast("double").alias("progress"), "at")
    return stream.withWatermark("at", overlap).groupBy("id").transformWithStateInPandas(Follow(ms), SNAPSHOT, "Update", "EventTime", initialState=kept.groupBy("id"), eventTimeColumnName="at")


def subscription(stream: DataFrame, snapshot: DataFrame, name: str, overlap: str = "30 seconds") -> DataFrame:
    """(kind, id, status, progress, at): what one who subscribes late is told up to now: the whole snapshot first, then each change once."""
    first = snapshot.select(F.lit("snapshot").alias("kind"), "id", "status", F.col("progress").cast("double").alias("progress"), "at")
    return first.unionByName(caught_up(deltas(stream, snapshot, overlap), name, "update").select(F.lit("delta").alias("kind"), "id", "status", "progress", "at"))


def polled(before: DataFrame, active: DataFrame, ended: DataFrame) -> DataFrame:
    """(id, change, status, progress): what one poll tells after the one before. before and active: id, status, progress of active jobs; ended: the same of jobs that have ended since. Of a job that is gone from the active ones the ending is told, or that it has vanished; a job that came and ended between two polls is told once."""
    a = active.select("id", F.struct("status", "progress").alias("_a"))
    b = before.select("id", F.struct("status", "progress").alias("_b"))
    e = ended.groupBy("id").agg(F.max_by(F.struct("status", "progress"), F.struct("status", "progress")).alias("_e"))
    x = b.join(a, "id", "full_outer").join(e, "id", "full_outer")
    change = F.when(F.col("_e").isNotNull(), "ended").when(F.col("_a").isNull(), "vanished").when(F.col("_b").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    last = F.coalesce("_e", "_a", "_b")
    return x.withColumn("change", change).filter("change is not null").select("id", "change", last["status"].alias("status"), last["progress"].alias("progress"))


def caught_up(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now: it runs in batches to the end, each of them a numbered commit, and its rows are read again; a batch that is repeated after a failure adds nothing. Update rows are appended, too; of a complete result the last one holds. With a folder, a later call goes on where this one stopped."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    log = Log(spark, f"{folder}/table")

    def keep(batch: DataFrame, number: int) -> None:
        log.append(number, batch)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return log.version(stream.schema)[1] if mode == "complete" else log.read(stream.schema)


def every(spark: SparkSession, step: Callable[[], DataFrame], sink: Callable[[DataFrame], None], interval: str, name: str) -> StreamingQuery:
    """Runs a step now and then at every interval until the query is stopped; what it gives goes to the sink. A step that fails is logged and the next one comes in its turn."""

    def run(_: DataFrame, number: int) -> None:
        try:
            sink(step())
        except Exception:
            logger.exception("%s: step %s failed; the next one comes at its time", name, number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", shared_folder(spark, name))
    return writer.trigger(processingTime=interval).start()
