"""Roll-ups, staleness and the job queue of a media catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import latest_per_key


def state_rollup(df: DataFrame, key: str, state: str, events: DataFrame | None = None) -> DataFrame:
    """(key, state): all current, all never, any never or stale, else failed. Of events (key) those without clips are current."""
    s = F.col(state)
    if events is not None:
        df = events.select(key).join(df.select(key, state), key, "left").withColumn(state, F.coalesce(s, F.lit("current")))
    return df.groupBy(key).agg(F.when(F.bool_and(s == "current"), "current").when(F.bool_and(s == "never"), "never").when(F.bool_or(s.isin("never", "stale")), "stale").otherwise("failed").alias("state"))


def status_counts(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values), F.count("*").alias("n"))


def readiness(df: DataFrame, key: str, health: str, values: list[str], ready: str) -> DataFrame:
    """A column for each health, total, and open: whether there is any row and all are ready."""
    p = df.groupBy(key).pivot(health, values).count().na.fill(0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return p.withColumn("total", total).withColumn("open", (total > 0) & (F.col(ready) == total))


def verdict(df: DataFrame, recorded: dict[str, Column], current: dict[str, Column], has_manifest: Column) -> DataFrame:
    """df with reasons (in order) and stale. Without a manifest that is the only reason."""
    diffs = F.array_compact(F.array(*(F.when(~recorded[k].eqNullSafe(current[k]), F.lit(k)) for k in recorded)))
    return df.withColumn("reasons", F.when(~has_manifest, F.array(F.lit("no_manifest"))).otherwise(diffs)).withColumn("stale", F.size("reasons") > 0)


def needs_render(verdicts: DataFrame) -> DataFrame:
    """Events that the verdict calls stale; a job that ended well does not count."""
    return verdicts.filter("stale")


def fingerprint(parts: dict[str, Column]) -> Column:
    return F.struct(*(F.sha2(c.cast("string"), 256).alias(k) for k, c in parts.items()), F.sha2(F.concat_ws("|", *(F.sha2(c.cast("string"), 256) for c in parts.values())), 256).alias("combined"))


def superseded(previous: Column, history: Column, new: Column) -> Column:
    """A manifest's history of outputs: distinct, in order, without the new one."""
    return F.array_remove(F.array_distinct(F.when(previous.isNull(), history).otherwise(F.array_append(history, previous))), new)


def carried(manifests: DataFrame, new: DataFrame, key: str = "event") -> DataFrame:
    """(key, output, superseded): the manifests after some renders. manifests: key, output, superseded; new: key, output, at most a row for each event. A new manifest carries the former outputs, without its own; events without a render keep theirs."""
    x = manifests.select(key, F.col("output").alias("_was"), "superseded").join(new.select(key, F.col("output").alias("_now")), key, "full_outer")
    history = F.coalesce("superseded", F.array().cast("array<string>"))
    return x.select(key, F.coalesce("_now", "_was").alias("output"), F.when(F.col("_now").isNull(), history).otherwise(superseded(F.col("_was"), history, F.col("_now"))).alias("superseded"))


#: What a job may become: a worker ends a running one, a queued one is claimed or cancelled, a lost one is queued again.
STEPS = {"queued": ["running", "cancelled"], "running": ["done", "failed", "cancelled", "queued"]}


def transitions(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, status, outcome) of every job: compare and set. wanted: id, expected, status, n (their order); a job moves only if it is in the expected state and may go to the next. Of several requests to one job each sees what the one before has left. outcome: moved, stale (another state than expected), illegal (no such step) or unknown (no such job, status null); null for jobs without a request, and that of the last request else.
    """
    requests = wanted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "expected", "status"))).alias("_w"))
    may = F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def step(acc: Column, w: Column) -> Column:
        fits, legal = acc["status"].eqNullSafe(w["expected"]), F.coalesce(F.array_contains(F.try_element_at(may, acc["status"]), w["status"]), F.lit(False))
        outcome = F.when(acc["status"].isNull(), "unknown").when(~fits, "stale").when(~legal, "illegal").otherwise("moved")
        return F.struct(F.when(outcome == "moved", w["status"]).otherwise(acc["status"]).alias("status"), outcome.alias("outcome"))

    x = jobs.select("id", "status").join(requests, "id", "full_outer")
    end = F.aggregate(F.coalesce("_w", F.array().cast(requests.schema["_w"].dataType)), F.struct(F.col("status"), F.lit(None).cast("string").alias("outcome")), step)
    return x.withColumn("_e", end).select("id", "_e.status", "_e.outcome")


def claimable(jobs: DataFrame, kinds: list[str], devices: list[str], k: int = 1) -> DataFrame:
    """The next k queued jobs: first kind first, priority high to low, oldest first. One writer owns claims; Spark has no row locks."""
    rank = F.lit(len(kinds))
    for i, kind in reversed(list(enumerate(kinds))):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    return jobs.filter((F.col("status") == "queued") & F.col("device").isin(*devices)).orderBy(rank, F.desc("priority"), "created_at", "id").limit(k)


def current_jobs(log: DataFrame) -> DataFrame:
    """An append-only log of transitions, reduced to each job's last state; a terminal state is never left."""
    ended = F.col("status").isin("done", "failed", "cancelled")
    return latest_per_key(log.withColumn("_ended", ended), ["id"], [F.desc("_ended"), F.when(F.col("_ended"), F.col("at")).asc(), F.desc("at"), F.desc("status")]).drop("_ended")


def orphans(running: DataFrame, workers: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs whose worker is gone, or that started before the cutoff."""
    gone = running.join(workers.select("worker_id"), "worker_id", "left_anti")
    old = running.filter(F.col("started_at") < cutoff)
    return gone.unionByName(old.select(*gone.columns)).distinct()


def submit(requests: DataFrame, active: DataFrame, key: list[str]) -> DataFrame:
    """Requests without an active job of the same key, once each: an idempotent append."""
    return requests.dropDuplicates(key).join(active.select(*key), key, "left_anti")


def due(clips: DataFrame, jobs: DataFrame, key: str = "event") -> DataFrame:
    """(key): events with pending clips that nothing holds back.

    clips: key, pending (an analysis would read the clip), touched (when it last changed); jobs: key, id, status, created_at, started_at, finished_at. Only a newest job that failed or was cancelled holds its event back, until a clip changes after that job began.
    """
    last = latest_per_key(jobs, [key], [F.desc("created_at"), F.desc("id")]).select(key, F.coalesce("started_at", "finished_at", "created_at").alias("_since"), F.col("status").alias("_status"))
    x = clips.groupBy(key).agg(F.bool_or("pending").alias("_pending"), F.max("touched").alias("_touched")).filter("_pending").join(last, key, "left")
    held = F.coalesce(F.col("_status").isin("failed", "cancelled"), F.lit(False)) & ~F.coalesce(F.col("_touched") > F.col("_since"), F.lit(False))
    return x.filter(~held).select(key)


def sweep(due_events: DataFrame, active: DataFrame, key: str, newest: str, k: int) -> DataFrame:
    """The newest k due events without an active job."""
    return due_events.join(active.select(key), key, "left_anti").orderBy(F.desc(newest), key).limit(k)
