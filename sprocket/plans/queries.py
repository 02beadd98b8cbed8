"""Registered queries of the catalog operators over the given tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, intervals, joins, sequences
from ..session import table
from . import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ------------------------------------------------------------------ spans: a supplier is a clip, its lines are spans

SPANS_SQL = "spans AS (SELECT l_suppkey AS clip, l_returnflag AS kind, (l_orderkey * 37 + l_linenumber * 211) % 86400 AS s, (l_orderkey * 37 + l_linenumber * 211) % 86400 + CAST(l_quantity AS BIGINT) * 4 AS e FROM lineitem)"
MERGE_SQL = "SELECT clip, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src})) GROUP BY clip, island"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 211) % 86400
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_returnflag").alias("kind"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 4).alias("end"))


@query(f"WITH {SPANS_SQL} SELECT clip, s AS start, e AS \"end\" FROM ({MERGE_SQL.format(src='spans')})")
def merged_spans(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_spans(spans(spark, sf), ["clip"])


@query(f"""WITH {SPANS_SQL}, cut AS (SELECT clip, greatest(s, 0) AS s, least(e, 86400) AS e FROM spans WHERE kind = 'R'), m AS ({MERGE_SQL.format(src='cut')}),
g AS (SELECT clip, e AS start, coalesce(lead(s) OVER (PARTITION BY clip ORDER BY s), 86400) AS "end" FROM m UNION ALL SELECT clip, 0, min(s) FROM m GROUP BY clip
UNION ALL SELECT s_suppkey, 0, 86400 FROM supplier WHERE s_suppkey NOT IN (SELECT clip FROM m)) SELECT * FROM g WHERE start < "end" """)
def kept_spans(spark: SparkSession, sf: str) -> DataFrame:
    clips = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.lit(86400).cast("long").alias("length"))
    return intervals.kept_spans(spans(spark, sf).filter("kind = 'R'"), clips, ["clip"])


_RESOLVE = f"""WITH {SPANS_SQL}, b AS (SELECT * FROM spans WHERE kind = 'A'), m AS ({MERGE_SQL.format(src='b')}),
f AS (SELECT row_number() OVER () AS id, * FROM spans WHERE kind <> 'A'), x AS (SELECT f.id, f.clip, f.kind, f.s, f.e, m.s AS ms, m.e AS me FROM f JOIN m ON f.clip = m.clip AND m.s < f.e AND m.e > f.s),
p AS (SELECT id, clip, kind, me AS a, least(e, coalesce(lead(ms) OVER (PARTITION BY id ORDER BY ms), e)) AS z FROM x UNION ALL SELECT id, clip, kind, s, min(ms) FROM x GROUP BY id, clip, kind, s
UNION ALL SELECT id, clip, kind, s, e FROM f WHERE id NOT IN (SELECT id FROM x))"""


@query(_RESOLVE + " SELECT clip, kind, a AS start, z AS \"end\" FROM p WHERE a < z UNION ALL SELECT clip, kind, s, e FROM b")
def priority_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.resolve_priority(spans(spark, sf), ["clip"], "kind", ["A"])


@query(_RESOLVE + " SELECT clip, a AS start, z AS \"end\" FROM p WHERE a < z")
def subtract_spans(spark: SparkSession, sf: str) -> DataFrame:
    x = spans(spark, sf)
    return intervals.subtract_spans(x.filter("kind <> 'A'"), x.filter("kind = 'A'"), ["clip"])


@query(f"WITH {SPANS_SQL} SELECT clip, CAST(sum(e - s) AS BIGINT) AS covered FROM ({MERGE_SQL.format(src='spans')}) GROUP BY clip")
def covered_time(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.measure(spans(spark, sf), ["clip"])


@query(f"WITH {SPANS_SQL}, m AS ({MERGE_SQL.format(src='spans')}) SELECT m.clip, m.s AS start, m.e AS \"end\", string_agg(DISTINCT kind, ',' ORDER BY kind) AS labels FROM m JOIN spans r ON r.clip = m.clip AND r.s < m.e AND r.e > m.s GROUP BY ALL")
def span_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = spans(spark, sf)
    return intervals.overlap_labels(x, ["clip"], "kind")


@query(f"""WITH {SPANS_SQL}, c AS (SELECT * FROM spans WHERE kind = 'A'), m AS ({MERGE_SQL.format(src='c')}),
q AS (SELECT row_number() OVER () AS id, clip, s, e FROM spans WHERE kind = 'R') SELECT q.clip, q.s AS start, q.e AS "end",
CASE WHEN bool_or(m.s <= q.s AND m.e >= q.e) THEN 'cut' WHEN bool_or(m.s < q.e AND m.e > q.s) THEN 'partly-cut' ELSE 'pending' END AS state FROM q LEFT JOIN m ON m.clip = q.clip GROUP BY id, q.clip, q.s, q.e""")
def suggestion_states(spark: SparkSession, sf: str) -> DataFrame:
    x = spans(spark, sf)
    return intervals.cover_state(x.filter("kind = 'R'").drop("kind"), x.filter("kind = 'A'"), ["clip"])


# ------------------------------------------------------------------ joins

@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'active' WHEN l.doc_id IS NOT NULL THEN 'missing' WHEN d.doc_id % 10 = 0 THEN 'ignored' ELSE 'new' END AS status
FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return joins.reconcile(docs.filter("doc_id % 7 <> 0"), table(spark, sf, "labels"), docs.filter("doc_id % 10 = 0"), "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT c.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def asof_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return joins.asof_join(e.filter("event_type = 'click'"), right, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@query("""WITH c AS (SELECT p_partkey AS claim, lower(p_brand || ' ' || p_type) AS folded FROM part), g AS (SELECT folded FROM c GROUP BY 1 HAVING count(DISTINCT claim) > 1)
SELECT a.claim, a.folded, string_agg(b.claim::VARCHAR, ',' ORDER BY b.claim) AS others FROM c a JOIN g USING (folded) JOIN c b ON a.folded = b.folded AND a.claim <> b.claim GROUP BY 1, 2""")
def output_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return joins.collisions(table(spark, sf, "part"), "p_partkey", S.fold(F.concat_ws(" ", "p_brand", "p_type")))


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def twin_documents(spark: SparkSession, sf: str) -> DataFrame:
    return joins.twins(table(spark, sf, "documents").select("doc_id", "text"), [F.sha2("text", 256)]).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def blocking_missing(spark: SparkSession, sf: str) -> DataFrame:
    disk = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(table(spark, sf, "customer"), disk, "c_custkey", F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("""WITH h AS (SELECT o_custkey AS event, max(o_orderkey) AS output, list(DISTINCT o_orderkey) AS old FROM orders GROUP BY 1), disk AS (SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_custkey + 1 AS event, o_orderkey AS path FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 11 = 0)
SELECT event, CAST(path AS VARCHAR) AS path FROM (SELECT event, output, unnest(old) AS path FROM h) x WHERE output IN (SELECT path FROM disk) AND path IN (SELECT path FROM disk) AND path <> output
AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = x.path AND c.event <> x.event)""")
def superseded_prune(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"))
    history = o.groupBy("event").agg(F.max("k").cast("string").alias("output"), F.collect_set("path").alias("superseded"))
    claimed = o.filter("k % 7 = 0").withColumn("event", F.col("event") + 1).unionByName(o.filter("k % 11 = 0"))
    return joins.prunable(history, o.filter("k % 5 <> 0"), claimed)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.n_chars % 2)")
def incremental_work(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("signal"))
    return joins.incremental(listing, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("signal")), "doc_id", "signal").select("doc_id")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.s IS DISTINCT FROM b.s""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    after = o.filter("o_orderkey % 4 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("s")))
    return joins.changes(o.filter("o_orderkey % 5 <> 0"), after, "o_orderkey", ["s"])


# ------------------------------------------------------------------ sequences

@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms FROM conversations""")
def chapter_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.bounds(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text")).select("conv_id", "turn", "start_ms", "end_ms")


@query("""WITH x AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS c FROM events),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS band FROM x) SELECT user_id, event_type, CAST(band AS BIGINT) AS band, count(*) AS n FROM y GROUP BY ALL""")
def run_length_bands(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.bands(table(spark, sf, "events"), ["user_id"], ["ts"], "event_type").select("user_id", "event_type", "band", "n")


@query("SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high IS NULL OR value > high")
def rising_progress(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.rising(table(spark, sf, "events"), ["user_id"], ["ts"], "value").select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type <> 'view' THEN 1 ELSE 2 END, ts) AS r FROM events) WHERE r = 1")
def title_clip(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") != "view", 1).otherwise(2)
    return sequences.first_by(table(spark, sf, "events"), ["user_id"], rank, ["ts"]).select("user_id", "event_id")


@query("SELECT l_orderkey, sha256(string_agg(k, chr(10) ORDER BY k)) AS digest FROM (SELECT l_orderkey, concat_ws('|', l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey")
def clip_set_hash(spark: SparkSession, sf: str) -> DataFrame:
    """An event's clips are hashed in their order by one task, so a key is an event: here an order with its lines."""
    return sequences.ordered_hash(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"])


# every run that rises is tried: a conversation has few turns
@query("""WITH RECURSIVE c AS (SELECT conv_id, turn AS before, (turn * 7 + conv_id) % 11 AS after, CAST(length(text) AS DOUBLE) AS weight FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY after, before) AS k FROM c),
r AS (SELECT conv_id, k, before, weight AS total, [k] AS kept FROM n UNION ALL SELECT r.conv_id, n.k, n.before, r.total + n.weight, list_append(r.kept, n.k) FROM r JOIN n ON n.conv_id = r.conv_id AND n.k > r.k AND n.before > r.before),
best AS (SELECT conv_id, arg_max(kept, total) AS kept FROM r GROUP BY conv_id)
SELECT n.conv_id, before, after, weight, NOT list_contains(kept, k) AS moved FROM n JOIN best ON best.conv_id = n.conv_id""")
def moved_clips(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("before"), F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(11)).alias("after"), F.length("text").cast("double").alias("weight"))
    # the SQL takes the first of several heaviest runs, and it makes short runs before long ones, those of late rows before those of early ones
    return sequences.moved(c, "conv_id", "before", "after", "weight", late=True)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn AS before, (turn * 5 + conv_id) % 8 AS after, turn = conv_id % 3 AS last FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY after) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY before) AS was, count(*) OVER (PARTITION BY conv_id) + 1 AS base FROM c),
w AS (SELECT *, CAST(base * base + CASE WHEN was = k THEN base ELSE 0 END + CASE WHEN last THEN 0 ELSE 1 END AS BIGINT) AS weight FROM n),
r AS (SELECT conv_id, k, was, base, weight AS total FROM w UNION ALL SELECT r.conv_id, w.k, w.was, w.base, r.total + w.weight FROM r JOIN w ON w.conv_id = r.conv_id AND w.k > r.k AND w.was > r.was)
SELECT conv_id, CAST(max(total) // (max(base) * max(base)) AS BIGINT) AS kept, CAST(max(total) % (max(base) * max(base)) // max(base) AS BIGINT) AS in_place, max(base) - 1 AS n FROM r GROUP BY conv_id""")
def moved_by_hand(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a conversation's turns count as kept, and how many of those stand where they stood."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("before"), ((F.col("turn") * 5 + F.col("conv_id")) % 8).alias("after"), F.col("turn").alias("clip")).distinct()
    last = c.filter("clip = conv_id % 3").select("conv_id", "clip")
    m = sequences.moved_by_hand(c, "conv_id", "clip", "before", "after", last)
    place = lambda col: F.row_number().over(W.partitionBy("conv_id").orderBy(col))
    m = m.withColumn("same", place("before") == place("after"))
    return m.groupBy("conv_id").agg(F.count_if(~F.col("moved")).alias("kept"), F.count_if(~F.col("moved") & F.col("same")).alias("in_place"), F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS t, (event_id % 100) / 100::DOUBLE AS p FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, p) AS k FROM e),
s AS (SELECT user_id, k, t, p, NULL::DOUBLE AS rate, 1 AS observations, NULL::DOUBLE AS shown FROM n WHERE k = 1
UNION ALL SELECT x.user_id, x.k, CASE WHEN same THEN old_t ELSE t END, CASE WHEN same THEN old_p ELSE p END, new_rate, new_n, CASE WHEN same THEN old_shown WHEN back OR p <= 0.05 OR new_n < 3 THEN NULL ELSE least(coalesce(old_shown, (1 - p) / new_rate), (1 - p) / new_rate) END
FROM (SELECT *, CASE WHEN same THEN old_rate WHEN back THEN NULL WHEN old_rate IS NULL THEN now ELSE 0.3::DOUBLE * now + (1 - 0.3::DOUBLE) * old_rate END AS new_rate, CASE WHEN same THEN old_n WHEN back THEN 1 ELSE old_n + 1 END AS new_n
FROM (SELECT n.*, s.t AS old_t, s.p AS old_p, s.rate AS old_rate, s.observations AS old_n, s.shown AS old_shown, n.p < s.p AS back, n.p >= s.p AND (n.p = s.p OR n.t <= s.t) AS same, (n.p - s.p) / (n.t - s.t) AS now FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1) y) x)
SELECT user_id, rate, observations, shown FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.unix_timestamp("ts").alias("at"), (F.pmod(F.col("event_id"), F.lit(100)) / 100).alias("progress"))
    return sequences.eta(e, "user_id", "at", "progress")


# ------------------------------------------------------------------ roll-ups and the queue

_STATE = "CASE event_type WHEN 'purchase' THEN 'current' WHEN 'click' THEN 'stale' WHEN 'view' THEN 'never' ELSE 'failed' END"


@query(f"SELECT k, CASE WHEN bool_and(s = 'current') THEN 'current' WHEN bool_and(s = 'never') THEN 'never' WHEN bool_or(s IN ('never', 'stale')) THEN 'stale' ELSE 'failed' END AS state FROM (SELECT event_id // 3 AS k, {_STATE} AS s FROM events) GROUP BY k")
def event_state(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.state_rollup(table(spark, sf, "events").select(F.expr("event_id div 3").alias("k"), F.expr(_STATE).alias("s")), "k", "s")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.status_counts(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS total, count(*) = count(*) FILTER (WHERE o_orderstatus = 'F') AS open FROM orders GROUP BY 1")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.readiness(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], "F")


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def year_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'no_manifest' ELSE concat_ws(',', CASE WHEN quality IS DISTINCT FROM n_chars % 2 THEN 'editorial' END, CASE WHEN toxic IS DISTINCT FROM doc_id % 2 THEN 'clip_set' END) END AS reasons
FROM documents LEFT JOIN labels USING (doc_id)""")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    v = catalog.verdict(x, {"editorial": F.col("quality").cast("long"), "clip_set": F.col("toxic").cast("long")}, {"editorial": F.col("n_chars") % 2, "clip_set": F.col("doc_id") % 2}, F.col("quality").isNotNull())
    return v.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 25")
def claim_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.lit("auto").alias("device"))
    return catalog.claimable(o, ["1-URGENT", "2-HIGH"], ["auto"], 25).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) OR o_orderdate < TIMESTAMP '1996-01-01')")
def orphan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    run = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("worker_id"), F.col("o_orderdate").alias("started_at"), "o_orderkey")
    live = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("worker_id"))
    return catalog.orphans(run, live, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def idempotent_submit(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return catalog.submit(o.select("o_custkey"), o.filter("o_orderstatus = 'P'"), ["o_custkey"])


# ------------------------------------------------------------------ scalars

@query("SELECT doc_id, greatest(1, CAST(ceil(n_chars / 120.0) AS BIGINT)) AS interval, greatest(1, CAST(ceil(n_chars::DOUBLE / greatest(1, ceil(n_chars / 120.0))) AS BIGINT)) AS tiles, least(greatest(1, CAST(ceil(n_chars::DOUBLE / greatest(1, ceil(n_chars / 120.0))) AS BIGINT)), 10) AS strip_columns, CAST(ceil(greatest(1, ceil(n_chars::DOUBLE / greatest(1, ceil(n_chars / 120.0)))) / 10.0) AS BIGINT) AS strip_rows FROM documents")
def filmstrip_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = S.filmstrip(F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", *(c.alias(k) for k, c in p.items()))


@query("SELECT p_partkey, CAST((((360 - p_size * 90) % 360 + 360) % 360 + 90) % 360 AS BIGINT) AS turn, CAST(greatest(2, floor(p_size / 2.0 + 0.5) * 2) AS BIGINT) AS even, greatest(1, CAST(round_even(p_size * 0.5, 0) AS BIGINT)) AS gop, p_size * 9 <> 50 * 16 AS pad FROM part")
def frame_geometry(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", S.turn(s * 90, F.lit(90)).cast("long").alias("turn"), S.even(s).alias("even"), S.gop(s).cast("long").alias("gop"), S.needs_pad(s, F.lit(50), F.lit(16), F.lit(9)).alias("pad"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 1000.0 / (p_size % 7) END AS rate FROM part")
def rational_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/"), (F.col("p_size") % 7).cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.rational(text).alias("rate"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date, 'Order ' || o_orderkey AS title, array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS location, strftime(o_orderdate, '%Y-%m-%d') || ' - Order ' || o_orderkey || ' - ' || array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '.mp4' AS output FROM orders")
def name_parse(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.concat_ws(" - ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "o_orderpriority")
    p = S.name_parts(folder)
    x = table(spark, sf, "orders").select("o_orderkey", p["event_date"].cast("string").alias("event_date"), p["title"].alias("title"), p["location"].alias("location"))
    return x.withColumn("output", S.output_name(F.col("event_date"), F.col("title"), F.col("location")))


@query("SELECT doc_id, lower(to_hex(n_chars)) || '-' || lower(to_hex(doc_id * 1000003)) AS tag, substr(sha256(source), 1, 16) || '.json' AS cache_key, n_chars * 1000 AS ms FROM documents")
def keys_and_times(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    clock = F.concat_ws(":", F.floor(n / 60).cast("string"), F.lpad((n % 60).cast("string"), 2, "0"))
    return table(spark, sf, "documents").select("doc_id", S.entity_tag(n, F.col("doc_id") * 1000003).alias("tag"), S.cache_key(F.col("source")).alias("cache_key"), S.parse_time(clock).alias("ms"))


@query("SELECT source, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS BIGINT)) AS BIGINT) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("source").distinct()  # a handful of rows: one task orders them
    return s.select("source", F.row_number().over(W.orderBy(S.natural_key(F.col("source")))).cast("long").alias("place"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ------------------------------------------------------------------ plans

@query("SELECT conv_id AS event, role AS chapter, CAST(turn AS DOUBLE) AS pos, 'source+overlay' AS kind FROM conversations UNION ALL SELECT conv_id, role, min(turn) - 0.5, 'card' FROM conversations GROUP BY 1, 2")
def decorated_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("event"), F.col("role").alias("chapter"), F.col("turn").alias("pos"), F.lit("source").alias("kind"))
    return registry.apply(c, ["title_card", "overlay"])


@query("""WITH d AS (SELECT source AS event, doc_id FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id, quality FROM labels),
x AS (SELECT s.source AS event, s.doc_id, d.doc_id IS NOT NULL AS disk, r.doc_id IS NOT NULL AS ref, r.quality FROM documents s LEFT JOIN d ON d.doc_id = s.doc_id LEFT JOIN r ON r.doc_id = s.doc_id)
SELECT event, count(*) FILTER (WHERE disk AND ref) AS n_active, count(*) FILTER (WHERE disk AND NOT ref) AS n_new, count(*) FILTER (WHERE ref AND NOT disk) AS n_missing, coalesce(bool_or(quality = 0), FALSE) AS stale FROM x GROUP BY event""")
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """For each event: clips that are active, new or missing, and whether it is stale."""
    docs, refs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("event")), table(spark, sf, "labels")
    none = docs.filter("false")
    status = joins.reconcile(docs.filter("doc_id % 7 <> 0"), refs, none, "doc_id")
    x = docs.join(status, "doc_id", "left").join(refs.select("doc_id", "quality"), "doc_id", "left")
    return x.groupBy("event").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("active", "new", "missing")), F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False)).alias("stale"))
