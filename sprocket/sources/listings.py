"""Readers of text and JSON that tools and sidecars leave: tolerant of damage, which becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,tags:map<string,string>>>,format:struct<duration:string,tags:map<string,string>>>"
#: Fixed value: how sure a detector's span is.
CONFIDENCE = 0.5
MANIFEST = "struct<version:int,fingerprint:string,output:string,superseded:array<string>,components:map<string,string>>"


def lines(log: Column) -> Column:
    return F.explode(F.split(log, r"\r?\n"))


def codecs(df: DataFrame, text: str) -> DataFrame:
    """(name): distinct names of a listing of encoders: flags, name, description."""
    x = df.select(lines(F.col(text)).alias("line")).select(F.regexp_extract("line", r"^\s*[A-Z.]{6}\s+(\S+)", 1).alias("name"))
    return x.filter("name <> ''").distinct()


def filters(df: DataFrame, text: str) -> DataFrame:
    """(name): names of a listing of filters: two or three flags, name, in->out."""
    x = df.select(lines(F.col(text)).alias("line")).select(F.regexp_extract("line", r"^\s*[A-Za-z.|]{2,3}\s+(\w+)\s+\S+->\S+", 1).alias("name"))
    return x.filter("name <> ''").distinct()


def accelerations(df: DataFrame, text: str) -> DataFrame:
    """(name): names of a listing of accelerations: single words below its header."""
    x = df.select(lines(F.col(text)).alias("line")).select(F.regexp_extract("line", r"^\s*(\S+)\s*$", 1).alias("name"))
    return x.filter("name <> '' and name not like '%:'").distinct()


def black_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end) of a detector's log."""
    a = F.regexp_extract_all(F.col(text), F.lit(r"black_start\s*:\s*([0-9.]+)\s+black_end\s*:\s*([0-9.]+)"), F.lit(1))
    b = F.regexp_extract_all(F.col(text), F.lit(r"black_start\s*:\s*([0-9.]+)\s+black_end\s*:\s*([0-9.]+)"), F.lit(2))
    x = df.select(key, F.explode(F.arrays_zip(a.alias("s"), b.alias("e"))).alias("x"))
    return x.select(key, F.col("x.s").try_cast("double").alias("start"), F.col("x.e").try_cast("double").alias("end")).filter("end > start")


def freeze_spans(df: DataFrame, key: str, text: str, length: str) -> DataFrame:
    """(key, start, end): a start pairs with the next end; a later start replaces an open one; a start open at the end closes at the clip's length, if that is known."""
    marks = F.regexp_extract_all(F.col(text), F.lit(r"freeze_(start|end)\s*:\s*[0-9.]+"), F.lit(0))
    none = F.struct(F.lit(None).cast("double").alias("open"), F.array().cast("array<struct<start:double,end:double>>").alias("done"))

    def step(acc: Column, m: Column) -> Column:
        t = F.regexp_extract(m, r"([0-9.]+)$", 1).try_cast("double")
        closes = m.startswith("freeze_end") & acc["open"].isNotNull()
        return F.struct(F.when(m.startswith("freeze_start"), t).alias("open"), F.when(closes, F.array_append(acc["done"], F.struct(acc["open"].alias("start"), t.alias("end")))).otherwise(acc["done"]).alias("done"))

    x = df.select(key, F.col(length).cast("double").alias("len"), F.aggregate(marks, none, step).alias("f"))
    last = F.when(F.col("f.open").isNotNull() & F.col("len").isNotNull(), F.array_append("f.done", F.struct(F.col("f.open").alias("start"), F.col("len").alias("end")))).otherwise(F.col("f.done"))
    return x.select(key, F.explode(last).alias("s")).select(key, "s.start", "s.end").filter("end > start")


def first_pass(df: DataFrame, key: str, text: str, length: str, least: float) -> DataFrame:
    """(key, kind, start, end, confidence): black and frozen spans of a log of at least so many seconds."""
    kinds = [(black_spans(df, key, text), "black"), (freeze_spans(df, key, text, length), "freeze")]
    black, freeze = (x.filter(F.col("end") - F.col("start") >= least).select(key, F.lit(kind).alias("kind"), "start", "end", F.lit(CONFIDENCE).alias("confidence")) for x, kind in kinds)
    return black.unionByName(freeze)


def probe(df: DataFrame, json: str = "json") -> DataFrame:
    """df with video (its first video stream), seconds, and problem: why the document is of no use, null if it is."""
    p = F.from_json(json, PROBE)
    x = df.withColumn("_p", p).withColumn("video", F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    seconds = F.coalesce(F.col("_p.format.duration").try_cast("double"), F.col("video.duration").try_cast("double"), F.lit(0.0))
    problem = F.when(F.col("_p").isNull() | F.col("_p.streams").isNull(), "unreadable").when(F.col("video").isNull(), "no video").when(F.col("video.width").isNull() | F.col("video.height").isNull(), "no size")
    return x.select(*df.columns, "video", seconds.alias("seconds"), problem.alias("problem"))


def manifest(df: DataFrame, json: str = "json", version: int = 1) -> DataFrame:
    """df with manifest; damaged text or another version is absence."""
    m = F.from_json(json, MANIFEST)
    return df.withColumn("manifest", F.when(m["version"] == version, m))
