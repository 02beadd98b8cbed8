"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, jaccard, langid, media, mixing, negatives, packing, pii, quality, resampling, suffixes, urllists, warc

#: The dated lists that op3 applies, beside a watch list of hosts: (pattern, list, action, at).
LIST_EVENTS = (
    ("casino-win.example.com", "gambling", "add", "2024-01-10 00:00:00"),
    ("casino-win.example.com", "gambling", "remove", "2024-05-01 00:00:00"),
    ("casino-win.example.com", "gambling", "add", "2024-08-15 12:00:00"),
    ("free-bets.example.com", "gambling", "add", "2024-03-01 00:00:00"),
    ("cheap-pills.example.com", "pharma", "add", "2024-02-01 00:00:00"),
    ("cheap-pills.example.com", "pharma", "remove", "2024-11-01 00:00:00"),
    ("spam-farm.example.com", "spam", "add", "2023-12-01 00:00:00"),
    ("spam-farm.example.com", "spam", "add", "2024-06-01 00:00:00"),
    ("ads-track.example.com", "tracking", "add", "2024-04-01 00:00:00"),
    ("ads-track.example.com", "tracking", "remove", "2024-04-02 00:00:00"),
    ("adult-x.example.net", "adult", "add", "2024-01-01 00:00:00"),
    ("www.adult-x.example.net", "spam", "add", "2024-07-01 00:00:00"),
    ("blog.tionsh.example.com/en", "spam", "add", "2024-09-01 00:00:00"),
    ("blog.tionsh.example.com/en", "spam", "remove", "2024-10-01 00:00:00"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_chunks(warc.write_archive(_table(spark, sf_dir, "pages")))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # pages carry no fetch time: one in 2024 is derived from the page's number
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 86477, F.lit(31536000))))
    events = spark.createDataFrame(list(LIST_EVENTS), "pattern string, list string, action string, at string").withColumn("at", F.to_timestamp("at"))
    # and of every third host a watch of some weeks, so that the lists grow with the pages
    hosts = pages.select(urllists.host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    hosts = hosts.withColumn("k", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")).filter("k % 3 = 0")
    day = F.col("k") % 300
    for action, at in (("add", day), ("remove", day + 20 + F.col("k") % 7)):
        events = events.unionByName(hosts.select("pattern", F.lit("watch").alias("list"), F.lit(action).alias("action"), F.timestamp_seconds(1704067200 + at * 86400).alias("at")))
    m = urllists.match(captures, events)
    return m.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_s"), F.array_join("lists", ",").alias("lists"), F.array_join("patterns", ",").alias("patterns"), "blocked")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    return langid.predict(docs, langid.fit(docs.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh row is labelled wrongly on purpose
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), label)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.without_repeats(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1,
        "op2_warc": op2,
        "op3_url_lists": op3,
        "op4_pii": op4,
        "op5_jaccard": op5,
        "op6_language": op6,
        "op7_mixing": op7,
        "op8_media": op8,
        "op9_main_text": op9,
        "op10_quality": op10,
        "op11_importance": op11,
        "op12_negatives": op12,
        "op13_suffixes": op13,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import OP2, OP3, OP10, OP11, OP12

    values = ", ".join(f"('{p}', '{n}', '{a}', TIMESTAMP '{t}')" for p, n, a, t in LIST_EVENTS)
    return {"op2_warc": OP2, "op3_url_lists": OP3.replace("$EVENTS", values), "op10_quality": OP10, "op11_importance": OP11, "op12_negatives": OP12}
