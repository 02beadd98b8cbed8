"""Quality rules with adaptive thresholds (operator 10, DataFrame functions only).

Each text gets integer metrics. For every (language, source) a mergeable quantile
sketch of each metric is built: a log-linear histogram, whose buckets hold values that
agree in their six leading bits (relative error at most 1/32). Sketches merge by adding
counts, so a group with few rows falls back to the merged sketch of its language, and a
language with few rows to the merged sketch of all. Fences at
``q10 - width * (q50 - q10)`` and ``q90 + width * (q90 - q50)`` replace fixed cutoffs.
Where more than half of the rows share a value the spread is no less than what a single
symbol, line or window adds to the rate of the group's median document, which the
sketches of the numbers of words and lines give, or than a bucket's width. The fences are
joined to the rows and a row beyond any fence is rejected.

Defined cases: null or empty text has no words and fails the base rule; null language
and null source are groups of their own; repeated rows each get the same verdict; an
empty table gives an empty result; other columns pass through untouched, those with the
name of a result give way to it (names that start with ``_q_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_BREAKS, written

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Metric:
    """An integer metric. low, high: which fences hold; once, per: a single find is worth once / (median of per), or a bucket's width if per is none."""

    name: str
    low: bool
    high: bool
    once: int = 0
    per: str = ""


METRICS = (
    Metric("mean_len", True, True),  # hundredths of a character a word
    Metric("symbol_rate", False, True, 1000, "words"),  # symbols in a thousand words
    Metric("dup_line_rate", False, True, 1000, "lines"),  # repeated lines in a thousand
    Metric("repeat_rate", False, True, 6000, "words"),  # words in repeated windows, of a thousand; the least repeat has two windows of three
    Metric("words", False, False),
    Metric("lines", False, False),
)
WIDTH = 8
MIN_ROWS = 100
#: Leading bits that a bucket keeps.
BITS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    for c in WORD_BREAKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeated(words: Column) -> Column:
    """Words in three-word windows found twice or more. Windows are compared by hash; only texts with a repeat sort theirs."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(pairs, marked)

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts of COUNTS."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("again")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    counted = df.select("*", of_words.alias("_q_words"), of_lines.alias("_q_of_lines"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    # the counts are read from the structs only after these are made: a filter on n_words must not compute the words again
    return counted.select(
        *df.columns,
        F.col("_q_words.n").cast("long").alias("n_words"),
        F.col("_q_words.chars").cast("long").alias("word_chars"),
        "n_symbols",
        F.col("_q_of_lines.again").cast("long").alias("n_dup_lines"),
        F.col("_q_words.again").cast("long").alias("n_repeat_words"),
        F.col("_q_of_lines.n").cast("long").alias("_q_n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates() -> list[Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_q_n_lines"), F.lit(1))
    of = {"mean_len": (100 * F.col("word_chars"), words), "symbol_rate": (1000 * F.col("n_symbols"), words), "dup_line_rate": (1000 * F.col("n_dup_lines"), lines), "repeat_rate": (1000 * F.col("n_repeat_words"), words), "words": (words, F.lit(1)), "lines": (lines, F.lit(1))}
    return [F.floor(of[m.name][0] / of[m.name][1]).cast("long").alias(f"_q_{m.name}") for m in METRICS]


def bucket_width(v: Column) -> Column:
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))).cast("long")


def bucket(v: Column) -> Column:
    """The least value that shares v's bucket."""
    return v - v % bucket_width(v)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, value, n): the sketches of all groups. Only rows that pass the base rule count."""
    rows = measured.filter(~base_failed()).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), bucket(F.col(f"_q_{m.name}")).alias("value")) for m in METRICS))).alias("x")
    )
    return rows.groupBy("lang", "source", "x.metric", "x.value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts add up."""
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """(keys, rows, lo_m, hi_m for each metric): quantiles from the sketch, then the fences."""
    by = W.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("value")), "all": F.sum("n").over(by)})
    at = {q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("value"))).alias(f"q{q}") for q in (10, 50, 90)}
    quantiles = ranked.groupBy(*keys, "metric").agg(*at.values(), F.max("all").alias("rows"))
    wide = quantiles.groupBy(*keys) if keys else quantiles.groupBy()
    wide = wide.agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("metric") == m.name, F.col(q))).alias(f"{m.name}_{q}") for m in METRICS for q in ("q10", "q50", "q90")))
    out = []
    for m in METRICS:
        q10, q50, q90 = (F.col(f"{m.name}_{q}") for q in ("q10", "q50", "q90"))
        least = F.greatest(F.floor(F.lit(m.once) / F.col(f"{m.per}_q50")), F.lit(1)).cast("long") if m.per else bucket_width(q50)
        if m.low or m.high:
            out += [(q10 - width * F.greatest(q50 - q10, least)).alias(f"lo_{m.name}"), (q90 + width * F.greatest(q90 - q50, least)).alias(f"hi_{m.name}")]
    return wide.select(*keys, "rows", *out)


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", width: int = WIDTH, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row for each (lang, source) with the fences that hold there: its own, its language's or those of all rows."""
    s = written(sketches(measured, lang, source), "quality-sketch")
    own, tongue, everything = fences(s, ["lang", "source"], width), fences(merged(s, ["lang"]), ["lang"], width), fences(merged(s, []), [], width)
    tongue = tongue.select(*(F.col(c).alias(f"t_{c}") for c in tongue.columns))
    everything = everything.select(*(F.col(c).alias(f"e_{c}") for c in everything.columns))
    # `everything` is one row by construction, so this join multiplies nothing
    x = own.join(tongue, own["lang"].eqNullSafe(tongue["t_lang"]), "left").join(F.broadcast(everything), F.lit(True), "left")
    pick = lambda c: F.when(F.col("rows") >= min_rows, F.col(c)).when(F.col("t_rows") >= min_rows, F.col(f"t_{c}")).otherwise(F.col(f"e_{c}"))
    return x.select("lang", "source", *(pick(f"{e}_{m.name}").alias(f"_q_{e}_{m.name}") for m in METRICS if m.low or m.high for e in ("lo", "hi")))


def judge(measured: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Joined filtering: adds base_failed and kept. A group without fences (all of it failed the base rule) keeps nothing more than the base rule does."""
    f = fence.select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), *(c for c in fence.columns if c.startswith("_q_")))
    beyond = F.lit(False)
    for m in (m for m in METRICS if m.low or m.high):
        v = F.col(f"_q_{m.name}")
        beyond = beyond | (v < F.col(f"_q_lo_{m.name}") if m.low else F.lit(False)) | (v > F.col(f"_q_hi_{m.name}") if m.high else F.lit(False))
    joined = measured.join(f, measured[lang].eqNullSafe(f["_q_lang"]) & measured[source].eqNullSafe(f["_q_source"]), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))


def quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", width: int = WIDTH, min_rows: int = MIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df) with COUNTS, base_failed and kept. The measured rows are written once, as they are needed twice; what is not kept is not written, but for language and source."""
    taken = (*COUNTS, "base_failed", "kept")
    own = [c for c in (df.columns if keep is None else keep) if c not in taken]
    stay = list(dict.fromkeys([*own, lang, source]))
    m = measure(df.select(*dict.fromkeys([*stay, text])), text).drop(*([] if text in stay else [text]))
    m = written(m.select("*", *_rates()), "quality")
    return judge(m, thresholds(m, lang, source, width, min_rows), lang, source).select(*own, *taken)
