"""Registered queries of the library, movie and key operators: rows that hold their ties, nulls and refusals for each of the given suppliers, and given tables as they are. Each stands beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import scalars as S
from ..operators import library as L
from ..operators import movie as M
from ..operators import catalog, sequences
from ..session import spread, table
from ..sources import listings
from .queries import query


class Cases:
    """Rows of odd cases for each of the given suppliers, whose number is a part of the keys: for Spark and as SQL. With keys=() the rows stand alone, as a small dimension."""

    def __init__(self, schema: str, *rows: tuple, keys: tuple[str, ...] | None = None) -> None:
        self.schema, self.rows = schema, rows
        self.columns = [c.strip().split(" ", 1) for c in schema.split(",")]
        self.keys = (self.columns[0][0],) if keys is None else keys

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        times = [c for c, t in self.columns if t in ("timestamp", "date")]
        plain = [(c, "string" if c in times else t) for c, t in self.columns]
        if not self.keys:
            x = spark.createDataFrame(list(self.rows), ", ".join(f"{c} {t}" for c, t in plain))
        else:
            case = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, plain, strict=True))) for r in self.rows))
            x = spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.explode(case).alias("c")).select("s_suppkey", "c.*")
            for c, t in plain:
                if c in self.keys:
                    x = x.withColumn(c, F.concat(c, F.lit("~"), "s_suppkey") if t == "string" else F.col(c) + 1000 * F.col("s_suppkey"))
        return x.select(*(F.col(c) if c in self.keys else F.col(c).cast(t).alias(c) for c, t in self.columns))

    @property
    def sql(self) -> str:
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}

        def text(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return str(v).upper() if isinstance(v, bool) else str(v)

        values = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in self.rows)
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        casts = ", ".join(f'CAST("{c}" AS {kinds[t]}) AS "{c}"' for c, t in self.columns)
        alone = f"SELECT {casts} FROM (VALUES {values}) v({names})"
        return f"({each(alone, **{c: t for c, t in self.columns if c in self.keys})})" if self.keys else f"({alone})"


def each(sql: str, **keys: str) -> str:
    """The rows that a query gives, for each supplier: keys are its key columns and their types."""
    new = ", ".join(f"{c} || '~' || s_suppkey AS {c}" if t == "string" else f"{c} + 1000 * s_suppkey AS {c}" for c, t in keys.items())
    return f"SELECT q.* REPLACE ({new}) FROM ({sql}) q, supplier"


# ------------------------------------------------------------------ folders and clips

FOLDERS = Cases(
    "root string, path string, year string, real string, linked boolean, marked boolean, pos int",
    ("r", "2019/lake", "2019", "/m/lake", False, False, 1), ("r", "2019/quay", "2019", "/m/quay", False, True, 2), ("r", "2020/lake again", "2020", "/m/lake", True, None, 3),
    ("r", "2020/hill", "2020", "/m/hill", True, False, 4), ("r", "2020/hill two", "2020", "/m/hill", True, False, 5), ("r", "2021/quay", "2021", "/m/quay", True, False, 6),
    ("s", "2020/lake", "2020", "/m/lake", None, None, 1), ("s", "2020/barn", "2020", "/m/barn", True, True, 2),
)


@query(f"SELECT root, path FROM (SELECT *, row_number() OVER (PARTITION BY root, real ORDER BY CASE WHEN linked THEN 1 ELSE 0 END, pos) AS n FROM {FOLDERS.sql} f WHERE marked IS NOT TRUE) WHERE n = 1 AND year IN ('2020', '2021')")
def listed_events(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_events(FOLDERS.df(spark, sf), ["2020", "2021"]).select("root", "path")


FILES = Cases(
    "event string, path string",
    ("a", "one.MP4"), ("a", "notes.txt"), ("a", "Dock/two.mov"), ("a", "Dock/deep/three.mov"), ("a", "Original/four.mp4"), ("a", "skip/five.mkv"), ("a", ".mp4"), ("a", "six"), ("b", "x/seven.3gp"), ("b", "x.y/eight.m2ts"), ("b", "nine.mp4.part"),
)
MARKED = Cases("event string, chapter string", ("a", "skip"), ("c", "x"))


@query(f"""WITH f AS (SELECT event, path, string_split(path, '/') AS p FROM {FILES.sql}) SELECT event, CASE WHEN len(p) = 2 THEN p[1] ELSE '' END AS chapter, path AS clip FROM f
WHERE len(p) <= 2 AND regexp_matches(path, '[^/]\\.(mp4|mov|m4v|avi|mkv|mts|m2ts|mpg|mpeg|wmv|3gp|flv|webm)$', 'i') AND NOT (len(p) = 2 AND (lower(p[1]) = 'original' OR EXISTS (SELECT 1 FROM {MARKED.sql} m WHERE m.event = f.event AND m.chapter = p[1])))""")
def listed_videos(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_videos(FILES.df(spark, sf), MARKED.df(spark, sf))


CLIPS = Cases(
    "event string, chapter string, clip string, mtime long",
    *((e, c, f"{c}/{n}" if c else n, t) for e in ("t", "f", "c", "tr", "none") for c, n, t in (("", "b10.mp4", 5), ("", "b2.mp4", 5), ("", "a.mp4", 9), ("k", "b2.mp4", 1), ("k", "3.mp4", 1), ("k", "z.mp4", 0))),
)
ORDERS = Cases("event string, method string, reverse boolean", ("t", "datetime", False), ("f", "filename", None), ("c", "custom", False), ("tr", "datetime", True))
CUSTOM = Cases("event string, name string, place int", ("c", "z.mp4", 1), ("c", "b10.mp4", 0), ("c", "b2.mp4", 2), ("f", "z.mp4", 0))


@query(f"""WITH x AS (SELECT c.*, coalesce(o.reverse, FALSE) AS rev, CASE WHEN o.method = 'datetime' THEN mtime END AS t, CASE WHEN o.method = 'custom' THEN u.place END AS place, regexp_extract(clip, '[^/]*$') AS name
FROM {CLIPS.sql} c LEFT JOIN {ORDERS.sql} o USING (event) LEFT JOIN {CUSTOM.sql} u ON u.event = c.event AND u.name = regexp_extract(c.clip, '[^/]*$')),
n AS (SELECT *, row_number() OVER (PARTITION BY event, chapter ORDER BY t, place IS NULL, place, regexp_matches(name, '^[a-z]'), regexp_extract(name, '^[a-z]*'), coalesce(TRY_CAST(regexp_extract(name, '[0-9]+') AS BIGINT), 1000), clip) AS n, count(*) OVER (PARTITION BY event, chapter) AS k FROM x)
SELECT event, chapter, clip, CASE WHEN rev THEN k + 1 - n ELSE n END AS pos FROM n""")
def ordered_clips(spark: SparkSession, sf: str) -> DataFrame:
    return L.order_clips(CLIPS.df(spark, sf), ORDERS.df(spark, sf), CUSTOM.df(spark, sf)).drop("mtime")


@query("SELECT conv_id AS event, role AS chapter, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS clips FROM (SELECT DISTINCT conv_id, role, turn FROM conversations) GROUP BY 1, 2")
def seeded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A chapter's clips are one list, as its document's are; here a conversation's turns by role."""
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("event"), F.col("role").alias("chapter"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("clip")).distinct()
    return L.seed_documents(d).withColumn("clips", F.array_join("clips", ","))


LISTING = Cases("event string, clip string, size long, mtime_ns long", *(("e", f"c{i}", 10 * i, i) for i in range(1, 10)))
SIDECARS = Cases(
    "event string, clip string, json string",
    ("e", "c1", '{"version": 1, "signal": {"size": 10, "mtime_ns": 1}, "segments": [{"start": 0, "end": 1.5, "kind": "black"}]}'),
    ("e", "c2", '{"version": 1, "signal": {"size": 20, "mtime_ns": 2}, "failure": "broken stream"}'),
    ("e", "c3", '{"version": 1, "signal": {"size": 31, "mtime_ns": 3}, "segments": []}'),
    ("e", "c4", '{"version": 2, "signal": {"size": 40, "mtime_ns": 4}, "segments": []}'),
    ("e", "c5", "not json"),
    ("e", "c6", '{"version": 1, "signal": {"size": 60, "mtime_ns": 6}, "segments": []}'),
    ("e", "c7", '{"version": 1, "signal": {"size": 70, "mtime_ns": 7}}'),
    ("e", "c8", '{"version": 1, "signal": {"size": 80, "mtime_ns": 8}, "segments": [{"start": 2, "end": 1, "kind": "white"}]}'),
    ("x", "c9", '{"version": 1, "signal": {"size": 90, "mtime_ns": 9}, "segments": []}'),
)
_KINDS = f"""l AS (SELECT l.event, l.clip, s.json, CASE WHEN json_valid(s.json) THEN s.json END AS j, l.size, l.mtime_ns FROM {LISTING.sql} l LEFT JOIN {SIDECARS.sql} s USING (event, clip)),
m AS (SELECT event, clip, json, j, coalesce(CAST(j->>'$.version' AS INT) = 1 AND CAST(j->>'$.signal.size' AS BIGINT) = size AND CAST(j->>'$.signal.mtime_ns' AS BIGINT) = mtime_ns, FALSE) AS mine,
  json_array_length(j, '$.segments') AS n, (j->'$.segments[0].end')::DOUBLE > (j->'$.segments[0].start')::DOUBLE AS up, j->>'$.failure' AS cause FROM l),
k AS (SELECT event, clip, CASE WHEN json IS NULL THEN 'absent' WHEN NOT mine THEN 'other' WHEN n = 0 OR up THEN 'result' WHEN n IS NULL AND cause IS NOT NULL THEN 'failure' ELSE 'other' END AS kind, n, cause FROM m)"""


@query(f"WITH {_KINDS} SELECT event, clip, kind, CASE WHEN kind = 'result' THEN CAST(n AS BIGINT) END AS n, CASE WHEN kind = 'failure' THEN cause END AS failure FROM k")
def sidecar_kinds(spark: SparkSession, sf: str) -> DataFrame:
    x = L.sidecar_kinds(LISTING.df(spark, sf), SIDECARS.df(spark, sf))
    return x.select("event", "clip", "kind", F.when(F.col("segments").isNotNull(), F.size("segments").cast("long")).alias("n"), "failure")


@query(f"WITH {_KINDS} SELECT event, clip FROM k WHERE kind IN ('absent', 'other')")
def pending_clips(spark: SparkSession, sf: str) -> DataFrame:
    return L.pending_clips(L.sidecar_kinds(LISTING.df(spark, sf), SIDECARS.df(spark, sf))).select("event", "clip")


# ------------------------------------------------------------------ documents

REFS = Cases(
    "event string, chapter string, pos int, clip string",
    ("a", "", 1, "p"), ("a", "", 2, "q"), ("a", "", 3, "r"), ("a", "Dock", 1, "s"), ("a", "Dock", 2, "t"), ("b", "", 1, "p"), ("b", "", 2, "q"), ("b", "Pier", 1, "p"), ("c", "", 1, "u"), ("c", "", 2, "v"),
)
PROPS = Cases(
    "event string, clip string, title boolean, exclude boolean, rotate int",
    ("a", "p", False, None, 90), ("a", "q", None, True, None), ("a", "s", None, False, None), ("a", "t", True, None, 180), ("b", "p", False, None, None), ("b", "q", False, None, None), ("b", "zz", None, None, None), ("c", "u", None, True, None),
)
FACTS = Cases("event string, clip string, duration double", ("a", "p", 10.0), ("a", "r", 4.0), ("a", "s", 7.5), ("a", "t", 3.0), ("b", "q", 2.0), ("c", "v", 1.0))
IGNORED = Cases("event string, clip string", ("a", "w"), ("b", "q"), ("c", "u"), ("d", "x"))
_PLAYED = f"""i AS (SELECT r.*, p.title, p.exclude, p.rotate FROM {REFS.sql} r LEFT JOIN {PROPS.sql} p USING (event, clip) WHERE p.exclude IS NOT TRUE),
g AS (SELECT *, row_number() OVER (PARTITION BY event, chapter ORDER BY CASE WHEN title THEN 0 WHEN title IS NULL THEN 1 ELSE 2 END, pos) AS n FROM i)"""


@query(f"WITH {_PLAYED} SELECT event, chapter, pos, clip, rotate, n = 1 AND title IS DISTINCT FROM FALSE AS is_title, CASE WHEN f.duration IS NULL THEN 'no facts' END AS problem FROM g LEFT JOIN {FACTS.sql} f USING (event, clip)")
def resolved_clips(spark: SparkSession, sf: str) -> DataFrame:
    return L.resolve_clips(REFS.df(spark, sf), PROPS.df(spark, sf), FACTS.df(spark, sf))


@query("""WITH c AS (SELECT l_suppkey AS event, l_returnflag AS chapter, l_orderkey AS pos, l_linenumber AS clip FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY ALL),
k AS (SELECT event, clip, s AS start, s + 3 AS "end" FROM (SELECT DISTINCT event, clip, unnest([0, 5, 9]) AS s FROM c) WHERE (clip + s) % 2 = 1)
SELECT event, chapter, pos, row_number() OVER (PARTITION BY event, chapter, pos, clip ORDER BY start) AS part, clip, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM c JOIN k USING (event, clip)""")
def flat_segments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").filter("l_suppkey % 5 = 0").select(F.col("l_suppkey").alias("event"), F.col("l_returnflag").alias("chapter"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("clip")).distinct()
    k = c.select("event", "clip").distinct().withColumn("start", F.explode(F.array(*(F.lit(v).cast("long") for v in (0, 5, 9))))).filter("(clip + start) % 2 = 1").withColumn("end", F.col("start") + 3)
    return L.flatten_segments(c, k).withColumn("part", F.col("part").cast("long"))


POSTERS = Cases("event string, clip string", ("a", "p"), ("a", "q"), ("b", "zz"), ("c", "u"), ("d", "x"))


@query(f"""WITH {_PLAYED} SELECT event, clip, CASE WHEN (event, clip) IN (SELECT event, clip FROM {IGNORED.sql}) THEN 'ignored' WHEN (event, clip) IN (SELECT event, clip FROM {PROPS.sql} WHERE exclude) THEN 'excluded' ELSE 'missing' END AS reason
FROM {POSTERS.sql} WHERE (event, clip) NOT IN (SELECT event, clip FROM g)""")
def unplayed_posters(spark: SparkSession, sf: str) -> DataFrame:
    played = L.resolve_clips(REFS.df(spark, sf), PROPS.df(spark, sf), FACTS.df(spark, sf))
    return L.unplayed_posters(POSTERS.df(spark, sf), played, IGNORED.df(spark, sf), PROPS.df(spark, sf))


@query(f"""SELECT event, clip, 'duplicate' AS problem FROM {REFS.sql} GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT event, clip, 'dangling' FROM {PROPS.sql} WHERE (event, clip) NOT IN (SELECT event, clip FROM {REFS.sql})
UNION ALL SELECT event, clip, 'ignored and used' FROM {IGNORED.sql} WHERE (event, clip) IN (SELECT event, clip FROM {REFS.sql})""")
def document_problems(spark: SparkSession, sf: str) -> DataFrame:
    return L.document_problems(REFS.df(spark, sf), PROPS.df(spark, sf), IGNORED.df(spark, sf))


@query("SELECT c_nationkey, lower(c_mktsegment) AS folded, string_agg(n, ',' ORDER BY n) AS names FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS n FROM customer WHERE c_custkey % 40 = 1 OR c_custkey % 40 = 8) GROUP BY 1, 2 HAVING count(*) > 1")
def fold_twins(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey % 40 = 1 or c_custkey % 40 = 8")
    return L.fold_twins(c.select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("n")), "c_nationkey", "n")


@query("""WITH t AS (SELECT o_custkey AS event, o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0), m AS (SELECT o_custkey AS event, o_orderkey AS path FROM orders WHERE o_orderkey % 4 = 0 UNION SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey + 2, o_orderkey FROM orders WHERE o_orderkey % 9 = 0)
SELECT t.event, t.path, string_agg(DISTINCT CAST(m.event AS VARCHAR), ',' ORDER BY CAST(m.event AS VARCHAR)) AS by FROM t JOIN m ON m.path = t.path WHERE t.path % 5 <> 0 AND (t.event, t.path) NOT IN (SELECT event, path FROM m) GROUP BY 1, 2""")
def claimed_movies(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("path"))
    m = o.filter("path % 4 = 0").unionByName(o.filter("path % 2 = 0").withColumn("event", F.col("event") + 1)).unionByName(o.filter("path % 9 = 0").withColumn("event", F.col("event") + 2))
    return L.claimed_movies(o.filter("path % 3 = 0"), m, o.filter("path % 5 <> 0"))


NEW = Cases("event string, folder string, clip string", ("a", "Dock", "n1"), ("a", "dock", "n2"), ("a", "DOCK", "n3"), ("a", "", "n4"), ("a", "Yard", "n5"), ("b", "Dock", "n6"))
CHAPTERS = Cases("event string, chapter string, pos int", ("a", "", 1), ("a", "Dock", 2), ("a", "dock", 3), ("b", "Pier", 1))


@query(f"""SELECT n.*, coalesce((SELECT max(chapter) FROM {CHAPTERS.sql} c WHERE c.event = n.event AND c.chapter = n.folder), (SELECT arg_min(chapter, pos) FROM {CHAPTERS.sql} c WHERE c.event = n.event AND lower(c.chapter) = lower(n.folder)), '') AS chapter FROM {NEW.sql} n""")
def placed_clips(spark: SparkSession, sf: str) -> DataFrame:
    return L.place_clips(NEW.df(spark, sf), CHAPTERS.df(spark, sf))


META = Cases("id int, date date, title string", (1, "2024-05-01", "Lake"), (2, None, "Lake"), (3, "2024-05-01", "  "), (4, "2024-05-02", None), (5, "2024-06-02", "Lake"), (6, None, None))


@query(f"SELECT id, CASE WHEN date IS NULL THEN 'no date' WHEN coalesce(trim(title), '') = '' THEN 'no title' WHEN date > DATE '2024-06-01' THEN 'in the future' END AS reason FROM {META.sql}")
def processable_events(spark: SparkSession, sf: str) -> DataFrame:
    return L.processable(META.df(spark, sf), F.lit("2024-06-01").cast("date")).select("id", "reason")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view FROM events GROUP BY 1")
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    return L.tally(table(spark, sf, "events"), "user_id", "event_type", ["click", "view"])


# ------------------------------------------------------------------ jobs and states

STATES = Cases("event string, state string", ("a", "current"), ("a", "current"), ("b", "never"), ("c", "never"), ("c", "failed"), ("d", "failed"), ("d", "current"), ("e", "stale"))
EVENTS = Cases("event string", ("a",), ("b",), ("c",), ("d",), ("e",), ("empty",))


@query(f"""SELECT event, CASE WHEN count(state) = 0 OR bool_and(state = 'current') THEN 'current' WHEN bool_and(state = 'never') THEN 'never' WHEN bool_or(state IN ('never', 'stale')) THEN 'stale' ELSE 'failed' END AS state FROM {EVENTS.sql} e LEFT JOIN {STATES.sql} s USING (event) GROUP BY event""")
def states_of_all_events(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.state_rollup(STATES.df(spark, sf), "event", "state", EVENTS.df(spark, sf))


JOBS = Cases(
    "id int, event string, status string, created_at timestamp, started_at timestamp, finished_at timestamp",
    (1, "a", "failed", "2024-01-01", "2024-01-02", "2024-01-03"), (2, "b", "failed", "2024-01-01", "2024-01-05", None), (3, "c", "done", "2024-01-09", "2024-01-09", None), (4, "d", "cancelled", "2024-01-01", None, "2024-01-08"),
    (5, "e", "failed", "2024-01-01", None, None), (6, "e", "done", "2024-01-01", None, None), (7, "f", "running", "2024-01-02", "2024-01-02", None), (8, "h", "cancelled", "2024-01-01", None, None),
)
TOUCHED = Cases(
    "event string, pending boolean, touched timestamp",
    ("a", True, "2024-01-02 12:00:00"), ("b", True, "2024-01-04"), ("b", False, "2024-01-05"), ("c", True, "2024-01-01"), ("d", True, "2024-01-07"), ("e", True, "2023-01-01"), ("f", True, "2024-01-01"), ("g", True, "2024-01-01"), ("g2", False, "2024-01-01"), ("h", True, None),
)
_DUE = f"""j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created_at DESC, id DESC) AS n FROM {JOBS.sql}) WHERE n = 1), t AS (SELECT event, max(touched) AS touched FROM {TOUCHED.sql} GROUP BY 1 HAVING bool_or(pending)),
d AS (SELECT t.event, t.touched FROM t LEFT JOIN j USING (event) WHERE j.id IS NULL OR j.status NOT IN ('failed', 'cancelled') OR t.touched > coalesce(j.started_at, j.finished_at, j.created_at))"""


@query(f"WITH {_DUE} SELECT event FROM d")
def due_events(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.due(TOUCHED.df(spark, sf), JOBS.df(spark, sf))


SAMPLES = Cases("job string, t double, p double", ("a", 0.0, 0.0), ("a", 10.0, 0.1), ("a", 20.0, 0.1), ("a", 30.0, 0.4), ("a", 30.0, 0.5), ("a", 40.0, 0.45), ("b", 0.0, 0.5), ("b", 5.0, 0.2), ("b", 6.0, 0.25), ("b", 9.0, 0.26), ("b", 10.0, 0.5), ("c", 1.0, 0.9), ("d", 0.0, 0.0), ("d", 1.0, 0.01), ("d", 2.0, 0.02))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, p) AS i FROM {SAMPLES.sql}),
f(job, i, t, p, rate, n, shown) AS (SELECT job, i, t, p, CAST(NULL AS DOUBLE), 1, CAST(NULL AS DOUBLE) FROM s WHERE i = 1
UNION ALL SELECT job, i, CASE WHEN same THEN t0 ELSE t END, CASE WHEN same THEN p0 ELSE p END, CASE WHEN same THEN rate0 WHEN anew THEN NULL ELSE r END, CASE WHEN same THEN n0 WHEN anew THEN 1 ELSE n0 + 1 END,
  CASE WHEN same THEN shown0 WHEN anew OR p <= 0.05 OR n0 + 1 < 3 THEN NULL ELSE least(coalesce(shown0, (1 - p) / r), (1 - p) / r) END
  FROM (SELECT s.job, s.i, s.t, s.p, f.t AS t0, f.p AS p0, f.rate AS rate0, f.n AS n0, f.shown AS shown0, s.p < f.p AS anew, s.p >= f.p AND (s.p = f.p OR s.t <= f.t) AS same,
    CASE WHEN f.rate IS NULL THEN (s.p - f.p) / nullif(s.t - f.t, 0) ELSE 0.3 * ((s.p - f.p) / nullif(s.t - f.t, 0)) + 0.7 * f.rate END AS r FROM f JOIN s ON s.job = f.job AND s.i = f.i + 1))
SELECT job, round(rate, 9) AS rate, CAST(n AS INTEGER) AS observations, round(shown, 9) AS shown FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1""")
def shown_times(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.eta(SAMPLES.df(spark, sf), "job", "t", "p").select("job", F.round("rate", 9).alias("rate"), "observations", F.round("shown", 9).alias("shown"))


# ------------------------------------------------------------------ movies

LOOKS = Cases("event string, w int, h int, fps double", ("a", 1280, 720, None), ("b", 0, 720, 24.0), ("c", None, None, None))
RATES = Cases("event string, fps double", ("a", 25.0), ("a", 50.0), ("b", 30.0), ("c", 29.97), ("d", 12.5))


@query(f"SELECT event, CASE WHEN w > 0 AND h > 0 THEN w ELSE 1920 END::BIGINT AS width, CASE WHEN w > 0 AND h > 0 THEN h ELSE 1080 END::BIGINT AS height, coalesce(max(l.fps), max(r.fps)) AS fps FROM {RATES.sql} r LEFT JOIN {LOOKS.sql} l USING (event) GROUP BY event, w, h")
def movie_targets(spark: SparkSession, sf: str) -> DataFrame:
    looks = LOOKS.df(spark, sf).select("event", F.when(F.col("w").isNotNull(), F.array("w", "h")).alias("size"), "fps")
    return M.targets(RATES.df(spark, sf), looks)


TARGET = {"width": 1920, "height": 1080, "sar": "1:1", "pix_fmt": "yuv420p", "video_codec": "h264", "fps": 50.0, "audio_codec": "aac", "sample_rate": 48000, "channels": 2}
SEGMENTS = Cases("id int, clip string, whole boolean, rotate int, overlays int", *((i, c, w, r, o) for i, (c, w, r, o) in enumerate((c, w, r, o) for c in ("ok", "sar", "slow", "tall", "hdr", "mute", "gone", None) for w, r, o in ((True, None, 0), (True, 360, 0), (False, None, 0), (True, 90, 0), (True, None, 1)))))
PROBED = Cases(
    "clip string, width int, height int, sar string, pix_fmt string, video_codec string, fps double, audio_codec string, sample_rate int, channels int, rotation int, hdr boolean",
    ("ok", 1920, 1080, "0:1", "yuv420p", "h264", 50.0005, "aac", 48000, 2, 0, False), ("sar", 1920, 1080, "4:3", "yuv420p", "h264", 50.0, "aac", 48000, 2, None, None), ("slow", 1920, 1080, "1:1", "yuv420p", "h264", 25.0, "aac", 48000, 2, None, False),
    ("tall", 1920, 1080, None, "yuv420p", "h264", 50.0, "aac", 48000, 2, 90, False), ("hdr", 1920, 1080, "", "yuv420p", "h264", 50.0, "aac", 48000, 2, 0, True), ("mute", 1920, 1080, "1:1", "yuv420p", "h264", 50.0, None, None, None, 0, False),
    keys=(),
)


@query(f"SELECT id, coalesce(whole AND overlays = 0 AND coalesce(s.rotate, 0) % 360 = 0 AND clip = 'ok', FALSE) AS copy FROM {SEGMENTS.sql} s")
def copied_segments(spark: SparkSession, sf: str) -> DataFrame:
    return M.copy_eligible(SEGMENTS.df(spark, sf), PROBED.df(spark, sf), TARGET).select("id", "copy")


@query("SELECT s_nationkey, count(DISTINCT CAST(s_suppkey % 3 AS VARCHAR)) <= 1 AS uniform FROM supplier GROUP BY 1")
def uniform_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", *(F.when(F.col("s_suppkey") % 2 == 0, F.lit("1:1")).alias(c) if c == "sar" else (F.col("s_suppkey") % 3).cast("string").alias(c) for c in M.COPY_FIELDS))
    return M.copy_uniform(s, "s_nationkey")


SIZES = Cases(
    "id int, w int, h int, ratio string, rotation int",
    (1, 1920, 1080, "1:1", 0), (2, 1920, 1080, None, 90), (3, 1440, 1080, "4:3", None), (4, 720, 576, "64:45", 270), (5, 640, 360, "", 180), (6, 3840, 2160, "1:1", -90), (7, 101, 541, "1:1", 0), (8, 0, 10, "1:1", 0), (9, 10, 10, "0:1", 0), (10, 10, 10, "x", 0), (11, 1, 1, "1:1", 0), (12, 1081, 541, "3:2", 0),
)


@query(f"""WITH r AS (SELECT id, rotation, h, w, CASE WHEN coalesce(ratio, '') = '' THEN 1 WHEN regexp_matches(ratio, '^\\d+:\\d+$') THEN CAST(split_part(ratio, ':', 1) AS BIGINT) END AS n, CASE WHEN coalesce(ratio, '') = '' THEN 1 WHEN regexp_matches(ratio, '^\\d+:\\d+$') THEN CAST(split_part(ratio, ':', 2) AS BIGINT) END AS d FROM {SIZES.sql}),
t AS (SELECT id, d, CASE WHEN abs(coalesce(rotation, 0)) % 180 = 90 THEN h * d ELSE w * n END AS a, CASE WHEN abs(coalesce(rotation, 0)) % 180 = 90 THEN w * n ELSE h * d END AS b FROM r WHERE w > 0 AND h > 0 AND n > 0 AND d > 0),
q AS (SELECT id, CASE WHEN least(a, b) > 540 * d THEN a * 540 ELSE a END AS ta, CASE WHEN least(a, b) > 540 * d THEN b * 540 ELSE b END AS tb, CASE WHEN least(a, b) > 540 * d THEN least(a, b) ELSE d END AS u FROM t)
SELECT s.id, CASE WHEN u IS NOT NULL THEN CAST(greatest(2, 2 * ((ta + u) // (2 * u))) AS BIGINT) END AS width, CASE WHEN u IS NOT NULL THEN CAST(greatest(2, 2 * ((tb + u) // (2 * u))) AS BIGINT) END AS height FROM {SIZES.sql} s LEFT JOIN q USING (id)""")
def proxy_sizes(spark: SparkSession, sf: str) -> DataFrame:
    x = SIZES.df(spark, sf).withColumn("p", M.proxy_size(F.col("w"), F.col("h"), F.col("ratio"), F.col("rotation")))
    return x.select("id", F.when(F.col("p").isNotNull(), F.col("p.width")).alias("width"), F.when(F.col("p").isNotNull(), F.col("p.height")).alias("height"))


@query("SELECT o_custkey AS event, o_orderpriority AS key, arg_min(o_orderkey, o_orderkey) AS clip, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS clips, greatest(1, CAST(arg_min(o_orderkey % 3, o_orderkey) AS BIGINT)) AS weight FROM orders GROUP BY 1, 2")
def proxy_work(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("clip"), F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 3).alias("size"))
    return M.proxy_work(o)


@query("SELECT p_partkey AS key, CASE WHEN p_size % 4 = 1 THEN 'ready' WHEN p_size % 3 = 0 THEN 'failed' WHEN p_size % 4 = 2 THEN 'stale' ELSE 'absent' END AS state FROM part")
def proxy_states(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size")
    entries = p.filter("p_size % 4 in (1, 2)").select("key", (F.lit(3) - F.col("p_size") % 4).alias("proxy_version"))
    return M.proxy_states(p.select("key"), entries, p.filter("p_size % 3 = 0").select("key", F.lit("broken").alias("cause")), 2)


PARTS = Cases(
    "event string, pos int, chapter string, kind string, seconds double",
    ("a", 1, "Intro", "source", 2.0005), ("a", 2, "Main", "source", 1.0), ("a", 3, "Main", "card", 2.5), ("a", 4, "Main", "source", 0.0005), ("a", 5, "Intro", "source", 1.5), ("b", 1, "", "card", 1.25), ("b", 2, "", "card", 1.0), ("b", 3, "End", "source", 0.5), ("c", 1, "x", "source", 0.0),
)


@query(f"""WITH s AS (SELECT *, CAST(seconds AS DECIMAL(18, 9)) AS d, sum(CAST(seconds AS DECIMAL(18, 9))) OVER (PARTITION BY event, chapter ORDER BY pos) AS upto FROM {PARTS.sql}),
g AS (SELECT event, chapter, min(pos) AS pos, CAST(round_even(sum(d) * 1000, 0) AS BIGINT) AS ms, count(*) FILTER (WHERE kind = 'card') AS k, min(CAST(round_even((upto - d) * 1000, 0) AS BIGINT)) FILTER (WHERE kind = 'card') AS a, min(CAST(round_even(upto * 1000, 0) AS BIGINT)) FILTER (WHERE kind = 'card') AS b FROM s GROUP BY 1, 2),
e AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY event ORDER BY pos) AS BIGINT) AS end_ms FROM g)
SELECT event, chapter, end_ms - ms AS start_ms, end_ms, CASE WHEN k = 1 THEN end_ms - ms + a END AS card_start_ms, CASE WHEN k = 1 THEN end_ms - ms + b END AS card_end_ms, CASE WHEN k > 1 THEN 'two cards' END AS problem FROM e""")
def chapter_times(spark: SparkSession, sf: str) -> DataFrame:
    return M.chapter_times(PARTS.df(spark, sf))


MARKS = Cases("event string, pos int, name string, start double", ("a", 1, "x", 0.0), ("a", 2, "y", 1.5), ("b", 1, "x", 0.0), ("b", 2, "y", 0.0), ("c", 1, None, 0.0), ("d", 1, "x", -1.0), ("e", 1, "x", 3.0), ("f", 1, "x", None), ("f", 2, "y", 2.0))


@query(f"SELECT event, bool_and(coalesce(start >= 0 AND name IS NOT NULL AND (pos = 1 OR start > before), FALSE)) AS usable FROM (SELECT *, lag(start) OVER (PARTITION BY event ORDER BY pos) AS before FROM {MARKS.sql}) GROUP BY 1")
def usable_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return M.usable_chapters(MARKS.df(spark, sf))


@query("""WITH b AS (SELECT l_partkey AS clip, l_orderkey * 10 + l_linenumber AS key, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2), a AS (SELECT l_partkey AS clip, l_orderkey * 10 + l_linenumber AS key, min(l_suppkey + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS s FROM lineitem WHERE l_quantity < 45 GROUP BY 1, 2)
SELECT clip, count(*) FILTER (WHERE b.s IS NULL) AS added, count(*) FILTER (WHERE a.s IS NULL) AS removed, count(*) FILTER (WHERE a.s <> b.s) AS trimmed FROM b FULL JOIN a USING (clip, key) GROUP BY 1 HAVING added + removed + trimmed > 0""")
def cut_changes(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("clip"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_suppkey", (F.col("l_suppkey") + F.when(F.col("l_tax") > 0.06, 1).otherwise(0)).alias("after"))
    side = lambda f, c: x.filter(f).groupBy("clip", "key").agg(F.min(c).alias("start")).withColumn("end", F.col("start") + 1)
    return M.cut_changes(side("l_quantity > 10", "l_suppkey"), side("l_quantity < 45", "after"))


WAS = Cases("event string, key int, pos int, name string", ("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 3, 3, "z"), ("b", 1, 1, "x"), ("b", 2, 2, "y"), ("c", 1, 1, "x"))
NOW = Cases("event string, key int, pos int, name string", ("a", 2, 1, "y"), ("a", 9, 2, "new"), ("a", 3, 3, "zz"), ("b", 2, 1, "y"), ("b", 1, 2, "x"), ("d", 4, 1, None))


@query(f"""WITH x AS (SELECT event, key, b.pos AS bp, a.pos AS ap, b.name AS bn, a.name AS an FROM {WAS.sql} b FULL JOIN {NOW.sql} a USING (event, key)),
k AS (SELECT *, bp IS NOT NULL AND ap IS NOT NULL AS kept FROM x), r AS (SELECT *, kept AND row_number() OVER (PARTITION BY event, kept ORDER BY bp) <> row_number() OVER (PARTITION BY event, kept ORDER BY ap) AS moved FROM k)
SELECT event, count(*) FILTER (WHERE bp IS NULL) AS added, count(*) FILTER (WHERE kept AND an IS DISTINCT FROM bn) AS renamed, count(*) FILTER (WHERE ap IS NULL) AS deleted, bool_or(moved) AS reordered FROM r GROUP BY 1""")
def chapter_changes(spark: SparkSession, sf: str) -> DataFrame:
    return M.chapter_changes(WAS.df(spark, sf), NOW.df(spark, sf))


@query("SELECT o_custkey AS event, o_orderkey AS clip FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 1 AND o_orderstatus <> 'P'")
def ignored_clips(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("clip"), "o_orderstatus")
    edits = o.filter("clip % 3 = 0").withColumn("edit", F.lit("include")).unionByName(o.filter("clip % 3 = 1 and o_orderstatus <> 'P'").withColumn("edit", F.lit("ignore")))
    return M.ignored_now(o.filter("o_orderstatus = 'F'"), edits)


@query("""WITH c AS (SELECT user_id, epoch(ts)::BIGINT AS t, event_id FROM events), m AS (SELECT user_id, t // 86400 * 86400 + 20000 AS s, t // 86400 * 86400 + 50000 AS e FROM c GROUP BY ALL)
SELECT c.event_id, m.e AS "to" FROM c LEFT JOIN m ON m.user_id = c.user_id AND m.s <= c.t + 40 AND m.e > c.t + 40""")
def skipped_positions(spark: SparkSession, sf: str) -> DataFrame:
    # the nearest second, of two the even one
    at = F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    c = table(spark, sf, "events").select("user_id", at.alias("at"), "event_id")
    day = F.floor(F.col("at") / 86400) * 86400
    return M.skips(c, c.select("user_id", (day + 20000).alias("start"), (day + 50000).alias("end")).distinct(), ["user_id"], 40).select("event_id", "to")


@query("SELECT conv_id, turn AS at, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations")
def card_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("at"), F.length("text").cast("long").alias("length"))
    return M.gap_offsets(c, ["conv_id"]).drop("length")


@query("SELECT l_suppkey, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem WHERE l_quantity > 5 AND l_partkey <= 900 AND l_partkey + l_quantity >= 700 GROUP BY 1")
def visible_clips(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("index"), F.col("l_partkey").cast("double").alias("start"), (F.col("l_partkey") + F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0)).alias("end"))
    return M.visible(x, F.lit(700), F.lit(900), ["l_suppkey"])


@query("SELECT p_partkey, unnest(range(CAST(ceil(p_size / 7.0) * 7 AS BIGINT), CAST(p_size + 30 + 1 AS BIGINT), 7)) AS tick FROM part")
def ruler_ticks(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("low"), (F.col("p_size") + 30).cast("long").alias("high"), F.lit(7).cast("long").alias("step"))
    return M.ticks(v).select("p_partkey", "tick")


# ------------------------------------------------------------------ keys, names and texts

@query("SELECT doc_id, sha256('[\"' || source || '\", ' || n_chars || ', ' || doc_id || ', 3, \"proxy\"]') AS key FROM documents")
def file_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", K.file_key(F.col("source"), F.col("n_chars"), F.col("doc_id"), 3, "proxy").alias("key"))


NAMES = Cases("id int, name string", (1, "2024-05-01 - Lake.mp4"), (2, "Lake.mp4"), (3, "a/b.mp4"), (4, ".."), (5, ""), (6, "2024-05-01.mp4"), (7, None))


@query(f"SELECT id, CASE WHEN name IN ('', '.', '..') OR contains(name, '/') THEN NULL WHEN regexp_matches(name, '^\\d{{4}}-\\d\\d-\\d\\d - ') THEN left(name, 4) || '/' || name ELSE name END AS path FROM {NAMES.sql}")
def recorded_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return NAMES.df(spark, sf).select("id", K.recorded_output(F.col("name")).alias("path"))


DATED = Cases("id int, title string, date date", (1, "2024-05-01 - Lake", None), (2, "2024-05-01 - Lake", "2024-05-01"), (3, "2024-05-01 - Lake", "2024-05-02"), (4, "2024-02-30 - Lake", None), (5, "Lake", None), (6, None, "2024-05-01"), (7, "2024-05-01 - ", None))


@query(f"""WITH d AS (SELECT *, TRY_CAST(nullif(regexp_extract(title, '^(\\d{{4}}-\\d\\d-\\d\\d) - (.+)$', 1), '') AS DATE) AS p, regexp_extract(title, '^(\\d{{4}}-\\d\\d-\\d\\d) - (.+)$', 2) AS rest FROM {DATED.sql})
SELECT id, CASE WHEN p IS NOT NULL AND (date IS NULL OR date = p) THEN rest ELSE title END AS title, CAST(CASE WHEN p IS NOT NULL AND date IS NULL THEN p ELSE date END AS VARCHAR) AS date FROM d""")
def dated_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = K.dated_title(F.col("title"), F.col("date"))
    return DATED.df(spark, sf).select("id", t["title"].alias("title"), t["date"].cast("string").alias("date"))


LINES = Cases("id int, line string", (1, "out_time_us=1500000"), (2, "out_time_ms=7"), (3, "out_time=00:01"), (4, "ffmpeg version n7.1.3 built"), (5, "ffmpeg version 6.0-static"), (6, "version x"), (7, None), (8, "out_time_us=N/A"))


@query(f"""SELECT id, TRY_CAST(nullif(regexp_extract(line, '^out_time_(us|ms)=(-?\\d+)\\s*$', 2), '') AS BIGINT) AS micros, CASE WHEN regexp_matches(line, 'version n?\\d+\\.\\d+') THEN regexp_extract(line, 'version n?(\\d+\\.\\d+)', 1) END AS version FROM {LINES.sql}""")
def tool_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = K.tool_version(F.col("line"))
    return LINES.df(spark, sf).select("id", K.out_time(F.col("line")).alias("micros"), F.when(v.isNotNull(), F.concat_ws(".", v["major"], v["minor"])).alias("version"))


TURNS = Cases("id int, tag string, matrix string, r int, t double", (1, "90", None, 90, 1.5), (2, None, "-90.0", 45, -1.0), (3, "x", "450", 0, 0.0), (4, None, None, None, None), (5, "-0.6", "10", -180, 1e300), (6, "270", "270", 360, 2.0))


@query(f"""SELECT id, coalesce(((-CAST(round_even(TRY_CAST(tag AS DOUBLE), 0) AS BIGINT)) % 360 + 360) % 360, (CAST(round_even(TRY_CAST(matrix AS DOUBLE), 0) AS BIGINT) % 360 + 360) % 360) AS rotation, CASE WHEN r % 90 = 0 THEN r END AS rotate, CASE WHEN t >= 0 THEN t END AS seconds FROM {TURNS.sql}""")
def coerced_turns(spark: SparkSession, sf: str) -> DataFrame:
    return TURNS.df(spark, sf).select("id", K.rotation(F.col("tag"), F.col("matrix")).alias("rotation"), K.quarter_turns(F.col("r")).alias("rotate"), K.seconds(F.col("t")).alias("seconds"))


TYPED = Cases("id int, typed string", (1, "58.1"), (2, "0:58,125"), (3, "1:02:03.5"), (4, "0:99"), (5, "1.2345"), (6, " "), (7, "abc"), (8, None), (9, "61:00"), (10, "7"), (11, "0:99:99.12345"))


@query(f"""WITH x AS (SELECT id, trim(typed) AS t FROM {TYPED.sql}), m AS (SELECT id, t, regexp_matches(t, '^((\\d+:[0-5]\\d:[0-5]\\d)|(\\d+:[0-5]\\d)|\\d+)([.,]\\d+)?$') AS ok, string_split(regexp_extract(t, '^[0-9:]*'), ':') AS p, regexp_extract(t, '[.,](\\d+)$', 1) AS f FROM x)
SELECT id, CASE WHEN ok AND length(f) <= 3 THEN list_reduce(list_transform(list_filter(p, lambda v: v <> ''), lambda v: CAST(v AS BIGINT)), lambda a, v: a * 60 + v) * 1000 + CAST(rpad(f, 3, '0') AS BIGINT) END AS ms,
CASE WHEN t = '' THEN 'empty' WHEN NOT ok THEN 'unreadable' WHEN length(f) > 3 THEN 'too-precise' END AS refusal FROM m""")
def typed_times(spark: SparkSession, sf: str) -> DataFrame:
    return TYPED.df(spark, sf).select("id", S.parse_time(F.col("typed")).alias("ms"), S.time_refusal(F.col("typed")).alias("refusal"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 3600000 THEN (n_chars // 3600000) || ':' || lpad(CAST(n_chars // 60000 % 60 AS VARCHAR), 2, '0') || ':' ELSE (n_chars // 60000) || ':' END || lpad(CAST(n_chars // 1000 % 60 AS VARCHAR), 2, '0') || CASE WHEN n_chars % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(n_chars % 1000 AS VARCHAR), 3, '0'), '0') END AS clock FROM documents""")
def shown_clocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.format_time(F.col("n_chars")).alias("clock"))


FOLDER_NAMES = Cases("id int, folder string", (1, "2024-05-01 - a day AT the lake - east bay"), (2, "2024 - summer"), (3, "2024-02-30 - trip"), (4, "the house OF 3rd street"), (5, "2024-05-01"), (6, "  - "), (7, "2024-05-01-x - y - z"))
_EXPECTED = Cases("id int, date string, title string, location string, problems string, output string", (1, "2024-05-01", "A Day at the Lake", "East Bay", "", "2024/2024-05-01 - A Day at the Lake - East Bay.mp4"), (2, None, "Summer", None, "year-only", "Summer.mp4"), (3, None, "Trip", None, "impossible-date", "Trip.mp4"), (4, None, "The House of 3rd Street", None, "no-date", "The House of 3rd Street.mp4"), (5, "2024-05-01", None, None, "no-title", "2024/2024-05-01 - Untitled.mp4"), (6, None, None, None, "no-date,no-title", "Untitled.mp4"), (7, "2024-05-01", "X - Y", "Z", "", "2024/2024-05-01 - X - Y - Z.mp4"))


@query(f"SELECT id, date, title, location, problems, output FROM {_EXPECTED.sql}")
def folder_names(spark: SparkSession, sf: str) -> DataFrame:
    p = S.name_parts(F.col("folder"))
    x = FOLDER_NAMES.df(spark, sf).select("id", p["event_date"].alias("d"), p["title"].alias("title"), p["location"].alias("location"), F.array_join(p["problems"], ",").alias("problems"))
    return x.select("id", F.col("d").cast("string").alias("date"), "title", "location", "problems", S.output_path(F.col("d"), F.col("title"), F.col("location")).alias("output"))


RATIONALS = Cases("id int, r string", (1, "30000/1001"), (2, "25"), (3, "1e3/10"), (4, "0/0"), (5, "x/1"), (6, " 50 / 2 "), (7, None), (8, "1/2/3"), (9, "/5"))


@query(f"SELECT id, CASE WHEN contains(r, '/') THEN TRY_CAST(trim(split_part(r, '/', 1)) AS DOUBLE) / nullif(TRY_CAST(trim(substr(r, instr(r, '/') + 1)) AS DOUBLE), 0) END AS rate FROM {RATIONALS.sql}")
def rational_cases(spark: SparkSession, sf: str) -> DataFrame:
    return RATIONALS.df(spark, sf).select("id", S.rational(F.col("r")).alias("rate"))


LOGS = Cases("id string, log string, len double", ("a", "x black_start:0 black_end:3 y\nblack_start : 5.5  black_end : 5.75\nfreezedetect.freeze_start: 1\nfreezedetect.freeze_start: 2\nfreezedetect.freeze_end: 4\nfreezedetect.freeze_start: 8", 10.0), ("b", "freezedetect.freeze_end: 4\nfreezedetect.freeze_start: 8", None), ("c", "", 1.0))


@query(each("SELECT * FROM (VALUES ('a', 'black', 0.0::DOUBLE, 3.0::DOUBLE), ('a', 'freeze', 2.0, 4.0), ('a', 'freeze', 8.0, 10.0)) v(id, kind, start, \"end\")", id="string"))
def detected_spans(spark: SparkSession, sf: str) -> DataFrame:
    x = LOGS.df(spark, sf)
    both = listings.black_spans(x, "id", "log").withColumn("kind", F.lit("black")).unionByName(listings.freeze_spans(x, "id", "log", "len").withColumn("kind", F.lit("freeze")))
    return M.long_enough(both, 0.5).select("id", "kind", "start", "end")


TOOLS = Cases("id int, text string", (1, " V..... h264_x            encoder one\n V....D libx264-rgb  two\n ------\n A..... aac"), (2, " T.C scale  V->V  size\n .. acopy A->A copy\n ts. low V->V x\nnothing"), (3, "Hardware acceleration methods:\nvdpau\n cuda \n\ntwo words"))


@query("SELECT * FROM (VALUES ('codec', 'h264_x'), ('codec', 'libx264-rgb'), ('codec', 'aac'), ('filter', 'scale'), ('filter', 'acopy'), ('filter', 'low'), ('acceleration', 'vdpau'), ('acceleration', 'cuda')) v(what, name)")
def tool_listings(spark: SparkSession, sf: str) -> DataFrame:
    x = TOOLS.df(spark, sf)
    parts = [(listings.codecs(x.filter("id = 1"), "text"), "codec"), (listings.filters(x.filter("id = 2"), "text"), "filter"), (listings.accelerations(x.filter("id = 3"), "text"), "acceleration")]
    a, b, c = (df.select(F.lit(what).alias("what"), "name") for df, what in parts)
    return a.unionByName(b).unionByName(c)


HEADERS = Cases("id int, modified timestamp, header string, typed string, encoder string", (1, "2024-05-01 10:00:00.900", "Wed, 01 May 2024 10:00:00 GMT", "Dock", "libx264"), (2, "2024-05-01 10:00:01", "Wed, 01 May 2024 10:00:00 GMT", " original ", "h264_vaapi"), (3, "2024-05-01 10:00:00", "junk", "", None), (4, "2024-05-01 09:00:00", None, "Yard", "libx265"))


@query(f"SELECT id, coalesce(date_trunc('second', modified) > try_strptime(header, '%a, %d %b %Y %H:%M:%S GMT'), TRUE) AS changed, CASE WHEN trim(typed) = '' THEN 'empty' WHEN lower(trim(typed)) IN ('dock', 'pier') THEN 'taken' WHEN lower(trim(typed)) = 'original' THEN 'reserved' END AS refusal, CASE WHEN encoder IN ('libx264', 'libx265') THEN 'cpu' ELSE 'gpu' END AS class FROM {HEADERS.sql}")
def refusals(spark: SparkSession, sf: str) -> DataFrame:
    others = F.array(F.lit("DOCK"), F.lit("Pier"))
    return HEADERS.df(spark, sf).select("id", K.changed_since(F.col("modified"), F.col("header")).alias("changed"), K.chapter_refusal(F.col("typed"), others).alias("refusal"), K.encoder_class(F.col("encoder")).alias("class"))


@query("""SELECT o_orderkey, concat_ws(chr(10), strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 3 <> 0 THEN 'Plats: ' || o_orderpriority END) AS subtitle, '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || o_orderkey || chr(10) || 'END=' || (o_orderkey + 5) || chr(10) || 'title=a\\=' || o_orderstatus || chr(10) AS block FROM orders""")
def card_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", K.subtitle(F.col("o_orderdate"), F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise("  ")).alias("subtitle"), K.metadata_block(F.concat(F.lit("a="), "o_orderstatus"), k, k + 5).alias("block"))
