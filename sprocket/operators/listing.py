"""The list of all events: a summary of each, or why it cannot be read. One bad event never costs the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins

FAILURES = ["unreadable disk", "unusable metadata", "unparseable document"]


def event_rows(events: DataFrame, listing: DataFrame, documents: DataFrame, refs: DataFrame, ignored: DataFrame, excluded: DataFrame, jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(event, kind, failure, detail, title, date, location, n_clips, n_ignored, n_new, n_missing, n_blocking, job_id, job_status, stale, reasons).

    events: event, fault (why the folder cannot be listed, or null), metadata_problem; listing: event, clip; documents: event, problem, title, date, location, of events that have one; refs, ignored, excluded: event, clip; jobs: event, id, status, created_at; verdicts: event, stale, reasons.

    An event with a fault, an unusable name or a document that breaks a rule is a row of kind 'error' with the first of these and its text, and has no other value; the others are of kind 'event'. n_clips are all clips but the ignored ones; n_blocking are missing ones that are not excluded. job_id and job_status are of its newest job.
    """
    d = documents.select("event", "title", "date", "location", F.col("problem").alias("_problem"), F.lit(True).alias("_has"))
    x = events.join(d, "event", "left")
    failure = F.when(F.col("fault").isNotNull(), FAILURES[0]).when(F.col("metadata_problem").isNotNull(), FAILURES[1]).when(F.col("_problem").isNotNull(), FAILURES[2])
    x = x.withColumns({"failure": failure, "detail": F.coalesce("fault", "metadata_problem", "_problem")})
    clip = lambda df: df.select(F.struct("event", "clip").alias("k")).distinct()
    status = joins.reconcile(clip(listing), clip(refs), clip(ignored), "k").select("k.event", "k.clip", "status")
    status = status.join(excluded.select("event", "clip", F.lit(True).alias("_x")).distinct(), ["event", "clip"], "left")
    s = F.col("status")
    counts = status.groupBy("event").agg(
        F.count_if(s != "ignored").alias("n_clips"), F.count_if(s == "ignored").alias("n_ignored"), F.count_if(s == "new").alias("n_new"), F.count_if(s == "missing").alias("n_missing"), F.count_if((s == "missing") & F.col("_x").isNull()).alias("n_blocking")
    )
    newest = joins.latest_per_key(jobs, ["event"], [F.desc("created_at"), F.desc("id")]).select("event", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    x = x.join(counts, "event", "left").join(newest, "event", "left").join(verdicts.select("event", "stale", "reasons"), "event", "left")
    good = F.col("failure").isNull()
    numbers = [F.when(good, F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("n_clips", "n_ignored", "n_new", "n_missing", "n_blocking")]
    values = [F.when(good, F.col(c)).alias(c) for c in ("title", "date", "location")]
    last = [F.when(good, F.col(c)).alias(c) for c in ("job_id", "job_status", "stale", "reasons")]
    return x.select("event", F.when(good, "event").otherwise("error").alias("kind"), "failure", F.when(~good, F.col("detail")).alias("detail"), *values, *numbers, *last)
