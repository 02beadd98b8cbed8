"""Registered queries of the timeline and matching operators, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, timeline
from ..session import table
from .queries import MERGE_SQL, SPANS_SQL, query, spans

LENGTH, FPS, PPS, SLACK = 86400, 25, 40, 1000

CUTS_SQL = f"{SPANS_SQL}, cuts AS (SELECT clip, s, e FROM spans WHERE kind = 'R'), inside AS (SELECT clip, greatest(s, 0) AS s, least(e, {LENGTH}) AS e FROM cuts), m AS ({MERGE_SQL.format(src='(SELECT * FROM inside WHERE s < e)')})"
EXTENT_SQL = f"""ends AS (SELECT clip, max(CASE WHEN s <= 0 THEN e END) AS lead, min(CASE WHEN {LENGTH} - e < {SLACK} THEN s END) AS trail FROM m GROUP BY clip),
ext AS (SELECT clip, CASE WHEN trail > lead THEN lead ELSE 0 END AS in_at, CASE WHEN trail > lead THEN trail ELSE 0 END AS out_at FROM (SELECT s_suppkey AS clip, coalesce(lead, 0) AS lead, coalesce(trail, {LENGTH}) AS trail FROM supplier LEFT JOIN ends ON s_suppkey = clip))"""


def cuts(spark: SparkSession, sf: str, kind: str = "R") -> DataFrame:
    return spans(spark, sf).filter(F.col("kind") == kind).select("clip", "start", "end")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.lit(LENGTH).cast("long").alias("length"), F.lit(FPS).alias("fps"))


@query(f"WITH {CUTS_SQL}, {EXTENT_SQL} SELECT clip, in_at, out_at FROM ext")
def kept_extents(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.kept_extents(cuts(spark, sf), clips(spark, sf), ["clip"], slack=SLACK).select("clip", "in_at", "out_at")


@query(f"WITH {CUTS_SQL}, {EXTENT_SQL} SELECT m.clip, m.s AS start, m.e AS \"end\" FROM m JOIN ext USING (clip) WHERE s > 0 AND s >= in_at AND e <= out_at")
def interior_spans(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.interior_spans(cuts(spark, sf), clips(spark, sf), ["clip"], slack=SLACK)


@query(f"""WITH {CUTS_SQL}, o AS (SELECT DISTINCT clip, s, e FROM cuts), lim AS (SELECT o.clip, o.s, o.e, max(CASE WHEN n.e <= o.s THEN n.e END) AS p, min(CASE WHEN n.s >= o.e THEN n.s END) AS q FROM o JOIN o AS n USING (clip) GROUP BY o.clip, o.s, o.e)
SELECT clip, s AS start, e AS "end", least(greatest(coalesce(p, 0), 0), s) AS in_low, greatest(CAST(floor((least(e, {LENGTH}) - 120) / 40.0) AS BIGINT) * 40, s) AS in_high,
least(CAST(ceil((greatest(s, 0) + 120) / 40.0) AS BIGINT) * 40, e) AS out_low, greatest(least(coalesce(q, {LENGTH}), {LENGTH}), e) AS out_high FROM lim JOIN cuts USING (clip, s, e)""")
def trim_limits(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.trim_limits(cuts(spark, sf), clips(spark, sf), ["clip"])


@query(f"""WITH {SPANS_SQL}, c AS (SELECT DISTINCT clip, x FROM (SELECT clip, unnest([s, e]) AS x FROM spans WHERE kind = 'R' UNION ALL SELECT s_suppkey, unnest([0, {LENGTH}]) FROM supplier) WHERE x BETWEEN 0 AND {LENGTH}),
p AS (SELECT row_number() OVER () AS id, clip, s AS "at" FROM spans WHERE kind = 'A'), r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY abs(x - "at"), x) AS k FROM p JOIN c USING (clip) WHERE abs(x - "at") * {PPS} / 1000.0 <= 8)
SELECT clip, "at", x AS target FROM p LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (id)""")
def snapped_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = timeline.snap_candidates(cuts(spark, sf), clips(spark, sf), ["clip"])
    return timeline.snap(cuts(spark, sf, "A").select("clip", F.col("start").alias("at")), c, ["clip"], "at", PPS)


@query(f"""WITH {SPANS_SQL}, t AS (SELECT row_number() OVER () AS id, clip, s, CASE WHEN s % 50 = 0 THEN s ELSE e END AS e FROM spans WHERE kind = 'A')
SELECT clip, s AS start, e AS "end", CASE WHEN s >= e THEN 'order' WHEN s < 0 OR e > {LENGTH} THEN 'range' WHEN EXISTS (SELECT 1 FROM spans n WHERE n.kind = 'R' AND n.clip = t.clip AND n.s < t.e AND n.e > t.s) THEN 'overlap' END AS refusal FROM t""")
def typed_cuts(spark: SparkSession, sf: str) -> DataFrame:
    typed = cuts(spark, sf, "A").withColumn("end", F.when(F.col("start") % 50 == 0, F.col("start")).otherwise(F.col("end")))
    return timeline.check_cuts(typed, cuts(spark, sf), clips(spark, sf), ["clip"])


@query(f"""WITH {CUTS_SQL}, {EXTENT_SQL} SELECT clip, s AS start, e AS "end", (greatest(s, 0) - in_at) * {PPS} / 1000.0 AS left_px, (least(e, {LENGTH}) - greatest(s, 0)) * {PPS} / 1000.0 AS width_px
FROM cuts JOIN ext USING (clip) WHERE least(e, {LENGTH}) > greatest(s, 0) AND least(e, {LENGTH}) > in_at AND greatest(s, 0) < out_at""")
def cut_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    ext = timeline.kept_extents(cuts(spark, sf), clips(spark, sf), ["clip"], slack=SLACK)
    return timeline.cut_rectangles(cuts(spark, sf), ext, ["clip"], PPS)


LAID_SQL = "laid AS (SELECT o_custkey AS event, o_orderkey AS clip, o_orderkey % 7 AS in_at, o_orderkey % 7 + (o_orderkey % 5) * 100 AS out_at, coalesce(sum((o_orderkey % 5) * 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts_at FROM orders)"


def laid(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), o.alias("clip"), (o % 7).alias("in_at"), (o % 7 + o % 5 * 100).alias("out_at"))
    return timeline.layout(x, ["event"], ["clip"])


@query(f"WITH {LAID_SQL} SELECT * FROM laid")
def timeline_layout(spark: SparkSession, sf: str) -> DataFrame:
    return laid(spark, sf)


@query(f"""WITH {LAID_SQL}, held AS (SELECT * FROM laid WHERE out_at > in_at), p AS (SELECT o_orderkey AS point, o_custkey AS event, o_orderkey * 17 % 3000 - 100 AS "at" FROM orders),
x AS (SELECT p.point, p.event, p."at", held.clip, "at" - starts_at + in_at AS clip_ms, row_number() OVER (PARTITION BY point ORDER BY CASE WHEN starts_at <= "at" THEN 0 ELSE 1 END, CASE WHEN starts_at <= "at" THEN -starts_at ELSE starts_at END) AS k FROM p LEFT JOIN held USING (event))
SELECT point, event, "at", clip, clip_ms FROM x WHERE k = 1""")
def clip_lookup(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("event"), (F.col("o_orderkey") * 17 % 3000 - 100).alias("at"))
    return timeline.clip_at(points, laid(spark, sf), ["event"], "at", "clip")


@query("""WITH x AS (SELECT l_orderkey AS id, l_linenumber::DOUBLE AS s, l_linenumber + l_quantity AS e, l_partkey % 7 AS w FROM lineitem), y AS (SELECT *, ceil(least(w, e - s) * 25 - 0.000001) AS n FROM x)
SELECT id, w AS "window", 'whole' AS part, s AS start, e AS "end" FROM y WHERE NOT (n > 0 AND e - s - n / 25 >= 1) UNION ALL SELECT id, w, 'head', s, s + n / 25 FROM y WHERE n > 0 AND e - s - n / 25 >= 1
UNION ALL SELECT id, w, 'tail', s + n / 25, e FROM y WHERE n > 0 AND e - s - n / 25 >= 1""")
def segment_split(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 7).alias("window"), F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("end"), F.lit(FPS).alias("fps"))
    return timeline.split_segments(x, "window", "fps").drop("fps")


_RULE = """{n} AS (SELECT a.clip, a.i AS want, b.i AS have, '{rule}' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY clip{on} ORDER BY i) AS k FROM {w}) a JOIN (SELECT *, row_number() OVER (PARTITION BY clip{on} ORDER BY i) AS k FROM {h}) b USING (clip, k{on})),
w{n} AS (SELECT * FROM {w} x WHERE NOT EXISTS (SELECT 1 FROM {n} y WHERE y.clip = x.clip AND y.want = x.i)), h{n} AS (SELECT * FROM {h} x WHERE NOT EXISTS (SELECT 1 FROM {n} y WHERE y.clip = x.clip AND y.have = x.i))"""
_RULES = [_RULE.format(n=f"r{i}", rule=rule, on=on, w=f"wr{i - 1}" if i else "w", h=f"hr{i - 1}" if i else "h") for i, (rule, on) in enumerate([("same", ", s, e"), ("start", ", s"), ("end", ", e"), ("order", "")])]


@query("""WITH x AS (SELECT l_partkey AS clip, l_returnflag = 'N' AS old, l_orderkey % 40 AS s, l_orderkey % 40 + 1 + CAST(l_quantity AS BIGINT) % 3 AS e, row_number() OVER (PARTITION BY l_partkey, l_returnflag = 'N' ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS i FROM lineitem),
h AS (SELECT clip, s, e, i FROM x WHERE old), w AS (SELECT clip, s, e, i FROM x WHERE NOT old), """ + ", ".join(_RULES) + " SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT clip, i, NULL, NULL FROM wr3")
def span_matching(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    old = F.col("l_returnflag") == "N"
    place = F.row_number().over(W.partitionBy("l_partkey", old).orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    start = F.col("l_orderkey") % 40
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("clip"), old.alias("old"), start.alias("start"), (start + 1 + F.col("l_quantity").cast("long") % 3).alias("end"), place.cast("long").alias("index"))
    return matching.match_spans(x.filter("old"), x.filter("not old"), ["clip"])


# the greedy choice as a fold over an event's candidates, best first
@query("""WITH RECURSIVE x AS (SELECT l_suppkey AS event, l_linenumber AS chapter, l_returnflag AS flag, list_sort(list(DISTINCT l_partkey % 50)) AS clips FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT w.event, w.chapter AS wanted, e.chapter AS existing, len(list_intersect(w.clips, e.clips)) AS shared, w.clips <> e.clips AS differs FROM x w JOIN x e ON w.event = e.event AND w.flag = 'R' AND e.flag = 'A'),
n AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY differs, shared DESC, wanted, existing) AS k FROM p WHERE shared > 0),
f AS (SELECT event, k, [wanted] AS w, [existing] AS e, TRUE AS kept FROM n WHERE k = 1
UNION ALL SELECT n.event, n.k, CASE WHEN free THEN list_append(w, wanted) ELSE w END, CASE WHEN free THEN list_append(e, existing) ELSE e END, free
FROM (SELECT n.*, f.w, f.e, NOT list_contains(f.w, n.wanted) AND NOT list_contains(f.e, n.existing) AS free FROM f JOIN n ON n.event = f.event AND n.k = f.k + 1) n)
SELECT n.event, n.wanted, n.existing, CAST(n.shared AS BIGINT) AS shared FROM n JOIN f ON f.event = n.event AND f.k = n.k WHERE f.kept""")
def chapter_pairing(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("event"), F.col("l_linenumber").alias("chapter"), "l_returnflag").agg(F.sort_array(F.collect_set(F.col("l_partkey") % 50)).alias("clips"))
    return matching.pair_chapters(x.filter("l_returnflag = 'R'"), x.filter("l_returnflag = 'A'"))


@query("""WITH p AS (SELECT l_orderkey AS event, l_partkey AS clip, l_quantity AS duration, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d FROM lineitem),
q AS (SELECT event, max(clip) + CASE WHEN event % 3 = 0 THEN 1000000 ELSE 0 END AS clip, event % 40 AS at FROM p WHERE event % 3 <> 2 GROUP BY event),
f AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY a, b, c, d) AS k FROM p), x AS (SELECT p.event, p.duration, q.clip, q.at, row_number() OVER (PARTITION BY p.event ORDER BY a, b, c, d) AS k FROM p JOIN q ON p.event = q.event AND p.clip = q.clip)
SELECT f.event, CASE WHEN x.event IS NULL THEN f.clip ELSE x.clip END AS clip, CASE WHEN x.event IS NULL THEN f.duration * 0.5 ELSE x.at END AS at, CASE WHEN x.event IS NULL THEN 'default' ELSE 'explicit' END AS source,
CASE WHEN x.at >= x.duration THEN 'past end' WHEN x.event IS NULL AND q.event IS NOT NULL THEN 'not played' END AS problem FROM f LEFT JOIN q ON q.event = f.event LEFT JOIN (SELECT * FROM x WHERE k = 1) x ON x.event = f.event WHERE f.k = 1""")
def poster_frames(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("clip"), F.col("l_quantity").alias("duration"), "l_linenumber", "l_suppkey", "l_extendedprice")
    q = p.filter("event % 3 <> 2").groupBy("event").agg(F.max("clip").alias("m"))
    q = q.select("event", (F.col("m") + F.when(F.col("event") % 3 == 0, 1000000).otherwise(0)).alias("clip"), (F.col("event") % 40).alias("at"))
    return matching.resolve_posters(p, q, ["l_linenumber", "clip", "l_suppkey", "l_extendedprice"])


@query("""SELECT c_nationkey AS event, c_custkey AS chapter, coalesce(CASE WHEN c_acctbal < 0 THEN 'none' END, CASE WHEN n_regionkey = 1 THEN 'slide' END, 'fade') AS transition, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 2.5 END, CASE WHEN n_nationkey % 2 = 0 THEN 4.0 END, 3.0)::DOUBLE AS seconds
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def card_settings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("event"), F.col("c_custkey").alias("chapter"), F.when(F.col("c_acctbal") < 0, "none").alias("transition"), F.when(F.col("c_custkey") % 4 == 0, 2.5).alias("seconds"))
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("event"), F.when(F.col("n_regionkey") == 1, "slide").alias("transition"), F.when(F.col("n_nationkey") % 2 == 0, 4.0).alias("seconds"))
    return matching.resolve_cards(c.select("event", "chapter"), s, c, {"transition": "fade", "seconds": 3.0})


@query("""SELECT event, chapter, anchor FROM (SELECT l_suppkey AS event, l_linenumber AS chapter, coalesce(min(CASE WHEN l_partkey = s_suppkey THEN l_orderkey END), min(CASE WHEN l_returnflag <> 'N' THEN l_orderkey END)) AS anchor
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) WHERE anchor IS NOT NULL""")
def card_anchors(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("event"), F.col("l_linenumber").alias("chapter"), F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("clip"), F.when(F.col("l_returnflag") != "N", "source").otherwise("card").alias("kind"))
    titles = seg.select("event", "chapter").distinct().withColumn("title", F.col("event"))
    return matching.card_anchors(seg, titles, ["event", "chapter"])
