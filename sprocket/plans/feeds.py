"""Registered queries of the change feed: streams over the given events, run to their end, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..session import shared_folder, table
from ..sources.commits import Log
from ..streaming import feed
from .queries import query

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_VERSIONS = "v AS (SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'queued' END AS status, round(value, 0) AS progress, ts AS at FROM events WHERE event_id % 4 = 0)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return feed.files(spark, f"{sf}/event[s].parquet", EVENTS)


def versions(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("queued")
    return events(spark, sf).filter("event_id % 4 = 0").select(F.col("user_id").alias("id"), status.alias("status"), F.round("value", 0).alias("progress"), F.col("ts").alias("at"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = feed.caught_up(feed.windowed(events(spark, sf)), "windowed", "complete")
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_VERSIONS} SELECT id, status FROM v WHERE status = 'done' GROUP BY ALL")
def endings_once(spark: SparkSession, sf: str) -> DataFrame:
    return feed.caught_up(feed.finished(versions(spark, sf), "60 days"), "endings").select("id", "status")


@query(f"""WITH {_VERSIONS}, n AS (SELECT *, count(*) FILTER (WHERE status = 'done') OVER (PARTITION BY id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
lag(status) OVER w AS before, lag(progress) OVER w AS had FROM v WINDOW w AS (PARTITION BY id ORDER BY "at"))
SELECT id, status, progress, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at" FROM n WHERE ended = 0 AND (status IS DISTINCT FROM before OR progress IS DISTINCT FROM had)""")
def merged_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed.caught_up(feed.merged(versions(spark, sf), "60 days"), "merged", "update").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------------------ late subscribers and polls

_STATES = f"""{_VERSIONS}, mid AS (SELECT min("at") + (max("at") - min("at")) / 2 AS t FROM v), n AS (SELECT v.*, count(*) FILTER (WHERE status = 'done') OVER (PARTITION BY id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
lag(status) OVER w AS before, lag(progress) OVER w AS had FROM v WINDOW w AS (PARTITION BY id ORDER BY "at")),
early AS (SELECT * FROM n, mid WHERE ended = 0 AND "at" < t QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC) = 1)"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, later versions): what was so at half time, and the stream from then on."""
    v = versions(spark, sf)
    batch = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet").filter("event_id % 4 = 0")
    lo, hi = batch.agg(F.min("ts"), F.max("ts")).first()
    half = lo + (hi - lo) / 2
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("queued")
    before = batch.filter(F.col("ts") < half).select(F.col("user_id").alias("id"), status.alias("status"), F.round("value", 0).alias("progress"), F.col("ts").alias("at"))
    return catalog.current_jobs(before), v.filter(F.col("at") >= half)


@query(f"""WITH {_STATES} SELECT 'snapshot' AS kind, id, status, progress, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at" FROM early
UNION ALL SELECT 'delta', id, status, progress, strftime("at", '%Y-%m-%d %H:%M:%S') FROM n, mid WHERE "at" >= t AND ended = 0 AND (status IS DISTINCT FROM before OR progress IS DISTINCT FROM had)""")
def late_subscription(spark: SparkSession, sf: str) -> DataFrame:
    snapshot, later = _halves(spark, sf)
    return feed.subscription(later, snapshot, "late", "60 days").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_STATES}, late AS (SELECT * FROM n WHERE ended = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC) = 1),
b AS (SELECT id, status, progress FROM early WHERE status <> 'done'), a AS (SELECT id, status, progress FROM late WHERE status <> 'done' AND id % 7 <> 0), e AS (SELECT l.id, l.status, l.progress FROM late l, mid WHERE l.status = 'done' AND l."at" >= t)
SELECT coalesce(a.id, b.id, e.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'ended' WHEN a.id IS NULL THEN 'vanished' WHEN b.id IS NULL THEN 'new' ELSE 'changed' END AS change,
coalesce(e.status, a.status, b.status) AS status, coalesce(e.progress, a.progress, b.progress) AS progress
FROM b FULL JOIN a ON a.id = b.id FULL JOIN e ON e.id = coalesce(a.id, b.id) WHERE e.id IS NOT NULL OR a.id IS NULL OR b.id IS NULL OR a.status <> b.status OR a.progress <> b.progress""")
def polled_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a poll at the end tells after one at half time; the active read misses every seventh job."""
    snapshot, _ = _halves(spark, sf)
    batch = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet").filter("event_id % 4 = 0")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("queued")
    now = catalog.current_jobs(batch.select(F.col("user_id").alias("id"), status.alias("status"), F.round("value", 0).alias("progress"), F.col("ts").alias("at")))
    told = snapshot.filter("status = 'done'").select("id")
    return feed.polled(snapshot.filter("status <> 'done'"), now.filter("status <> 'done' and id % 7 <> 0"), now.filter("status = 'done'").join(told, "id", "left_anti"))


_RENDERS = "r AS (SELECT o_custkey AS event, year(o_orderdate) % 3 AS round, o_orderpriority || ' ' || (max(o_orderkey) % 4) || '.mp4' AS output, max(o_orderkey) AS k FROM orders GROUP BY o_custkey, year(o_orderdate) % 3, o_orderpriority)"


@query(f"""WITH {_RENDERS}, one AS (SELECT event, round, arg_max(output, k) AS output FROM r GROUP BY 1, 2), h AS (SELECT event, list(output ORDER BY round) AS all_ FROM one GROUP BY 1)
SELECT event, all_[len(all_)] AS output, array_to_string(list_filter(list_transform(range(1, len(all_)), lambda i: CASE WHEN list_position(all_, all_[i]) = i THEN all_[i] END), lambda x: x IS NOT NULL AND x <> all_[len(all_)]), '|') AS superseded FROM h""")
def versioned_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of renders, each a new version made of the one before; the second is sent twice under its number and counts once."""
    o = table(spark, sf, "orders").withColumn("round", F.year("o_orderdate") % 3)
    r = o.groupBy(F.col("o_custkey").alias("event"), "round", "o_orderpriority").agg(F.max("o_orderkey").alias("k"))
    r = r.groupBy("event", "round").agg(F.max_by(F.concat("o_orderpriority", F.lit(" "), F.col("k") % 4, F.lit(".mp4")), "k").alias("output"))
    schema = f"event {o.schema['o_custkey'].dataType.simpleString()}, output string, superseded array<string>"
    log = Log(spark, shared_folder(spark, "manifests"))
    for n in range(3):
        new = r.filter(F.col("round") == n)
        log.update(schema, lambda old, new=new: catalog.carried(old, new))
        if n == 1:
            log.append(1, catalog.carried(log.version(schema)[1], new))
    return log.version(schema)[1].withColumn("superseded", F.array_join("superseded", "|"))


@query("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'done' END AS status FROM orders),
w AS (SELECT id, status, CASE WHEN id % 5 = 0 THEN 'queued' ELSE status END AS expected, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'cancelled' END AS next FROM j WHERE id % 2 = 0),
o AS (SELECT id, CASE WHEN status <> expected THEN 'stale' WHEN (status = 'queued' AND next IN ('running', 'cancelled')) OR (status = 'running' AND next IN ('done', 'cancelled')) THEN 'moved' ELSE 'illegal' END AS first, status, next FROM w),
-- a second request expects what the first asked for and ends it
s AS (SELECT id, CASE WHEN first = 'moved' THEN next ELSE status END AS status, first, next FROM o),
z AS (SELECT id, CASE WHEN id % 4 <> 0 THEN first WHEN status <> next THEN 'stale' WHEN status = 'running' THEN 'moved' ELSE 'illegal' END AS outcome, CASE WHEN id % 4 = 0 AND status = next AND status = 'running' THEN 'failed' ELSE status END AS status FROM s)
SELECT j.id, coalesce(z.status, j.status) AS status, z.outcome FROM j LEFT JOIN z USING (id) UNION ALL SELECT -1, NULL, 'unknown'""")
def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("done")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    ask = jobs.filter("id % 2 = 0").withColumn("expected", F.when(F.col("id") % 5 == 0, "queued").otherwise(F.col("status")))
    ask = ask.select("id", "expected", F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "done").otherwise("cancelled").alias("status"), F.lit(1).alias("n"))
    again = ask.filter("id % 4 = 0").select("id", F.col("status").alias("expected"), F.lit("failed").alias("status"), F.lit(2).alias("n"))
    lost = jobs.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("queued").alias("expected"), F.lit("done").alias("status"), F.lit(1).alias("n"))
    return catalog.transitions(jobs, ask.unionByName(again).unionByName(lost))
