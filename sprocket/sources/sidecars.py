"""Strict readers of JSON that the library's own jobs leave beside the clips, and the rows that they write. What is incomplete or of another type is absence, never a default."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A rate is variable if average and base differ by more than one part in so many.
RATE_SHARE = 100
INFINITE = float("inf")


def _kind(value: Column) -> Column:
    """The JSON type of a variant: BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID (a null), ARRAY or OBJECT; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


FACTS = {
    "proxy_version": ("long", "BIGINT"), "duration": ("double", "BIGINT", "DECIMAL", "DOUBLE"), "fps.num": ("long", "BIGINT"), "fps.den": ("long", "BIGINT"),
    "vfr": ("boolean", "BOOLEAN", "VOID"), "frames": ("long", "BIGINT"), "width": ("long", "BIGINT"), "height": ("long", "BIGINT"), "source_width": ("long", "BIGINT"),
    "source_height": ("long", "BIGINT"), "rotation": ("long", "BIGINT", "VOID"), "audio_codec": ("string", "STRING", "VOID"), "encode_path": ("string", "STRING"), "fallback_reason": ("string", "STRING", "VOID"),
}


def proxy_facts(df: DataFrame, text: str, version: int) -> DataFrame:
    """df with facts: struct of a proxy's facts, null unless every field is there with its own type (1.0 is no whole number, true no number), of this version, with sizes and rate above 0 and a rotation below 360."""
    v = F.col("_v")
    field = {p: F.try_variant_get(v, f"$.{p}", kinds[0]) for p, kinds in FACTS.items()}
    good = (field["proxy_version"] == version) & (field["duration"] < INFINITE) & (field["rotation"].isNull() | field["rotation"].between(0, 359))
    for p, kinds in FACTS.items():
        good = good & _kind(F.try_variant_get(v, f"$.{p}", "variant")).isin(*kinds[1:])
    for p in ("fps.num", "fps.den", "width", "height", "duration"):
        good = good & (field[p] > 0)
    facts = F.struct(*(c.alias(p.replace(".", "_")) for p, c in field.items()))
    x = df.withColumn("_v", F.try_parse_json(text))  # parsed once a row
    return x.withColumn("facts", F.when(F.coalesce(good, F.lit(False)), facts)).drop("_v")


def _fraction(s: Column) -> tuple[Column, Column]:
    """Numerator and denominator of 'n/d', whole numbers above 0 of at most 15 digits; else nulls."""
    fits = s.rlike(r"^\s*\+?\d{1,15}\s*/\s*\+?\d{1,15}\s*$")
    num, den = (F.trim(F.get(F.split(s, "/"), F.lit(k))).try_cast("long") for k in (0, 1))
    ok = fits & (num > 0) & (den > 0)
    return F.when(ok, num), F.when(ok, den)


def _divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's rule; 75 steps suffice for 15 digits."""
    turn = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), F.try_mod(x["a"], x["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(75)), F.struct(a.alias("a"), b.alias("b")), turn)["a"]


def source_facts(df: DataFrame, base: str, average: str, frames: str, seconds: str) -> DataFrame:
    """df with fps_num, fps_den (lowest terms), vfr, declared_frames, video_seconds and problem. The base rate holds, else the average one; with neither there is a problem. vfr is null without an average. Frames and seconds that are no numbers above 0 are null."""
    (bn, bd), (an, ad) = _fraction(F.col(base)), _fraction(F.col(average))
    x = df.withColumns({"_n": F.coalesce(bn, an), "_d": F.coalesce(bd, ad), "_an": an, "_ad": ad}).withColumn("_g", _divisor(F.col("_n"), F.col("_d")))
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    off = F.abs(wide("_an") * wide("_d") - wide("_n") * wide("_ad"))
    count, length = F.trim(frames).try_cast("long"), F.trim(seconds).try_cast("double")
    return x.select(
        *df.columns,
        (F.col("_n") / F.col("_g")).cast("long").alias("fps_num"),
        (F.col("_d") / F.col("_g")).cast("long").alias("fps_den"),
        (off * RATE_SHARE > wide("_n") * wide("_ad")).alias("vfr"),
        F.when(count > 0, count).alias("declared_frames"),
        F.when((length > 0) & (length < INFINITE), length).alias("video_seconds"),
        F.when(F.col("_n").isNull(), "no usable rate").alias("problem"),
    )


def written_entries(kept: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """(event, clip, json): one entry for each clip; what a run wrote takes the place of what was there, a failure of a result and the other way round. kept: event, clip, json; results: event, clip, size, mtime_ns, segments (array of struct(start, end, kind)); failures: event, clip, size, mtime_ns, reason. If one run gives both, the result holds."""
    signal = F.struct("size", "mtime_ns").alias("signal")
    head = [F.lit(1).alias("version"), F.col("clip").alias("identity"), signal]
    new = results.select("event", "clip", F.to_json(F.struct(*head, "segments")).alias("json"), F.lit(0).alias("_n"))
    new = new.unionByName(failures.select("event", "clip", F.to_json(F.struct(*head, F.col("reason").alias("failure"))).alias("json"), F.lit(1).alias("_n")))
    both = new.unionByName(kept.select("event", "clip", "json", F.lit(2).alias("_n")))
    first = F.row_number().over(W.partitionBy("event", "clip").orderBy("_n", "json"))
    return both.withColumn("_r", first).filter("_r = 1").select("event", "clip", "json")


def published(entries: DataFrame, builds: DataFrame) -> DataFrame:
    """(key, json, generated): the first complete entry of a key holds and later builds go; an incomplete entry (json null) gives way. entries: key, json; builds: key, json, n (in order of their end)."""
    both = entries.select("key", "json", F.lit(-1).cast("long").alias("n")).unionByName(builds.select("key", "json", F.col("n").cast("long").alias("n"))).filter("json is not null")
    first = both.groupBy("key").agg(F.min_by(F.struct("json", (F.col("n") >= 0).alias("generated")), "n").alias("f"))
    return first.select("key", "f.json", "f.generated")


@F.pandas_udf(StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON document with sorted keys, so that neither the order of keys nor blanks tell; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            tree = json.loads(t)
        except (ValueError, RecursionError):
            return None
        return hashlib.sha256(json.dumps(tree, sort_keys=True).encode()).hexdigest()

    return text.map(one)


@F.pandas_udf(StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """A JSON document in canonical spelling: keys in order, all but ASCII escaped; null for what is no JSON. Values of a known type need no Python: see `functions.canonical`."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return text.map(one)


#: What a proxy is made to, in the order of their names.
PROXY_SPEC = '{"audio_bitrate": "128k", "audio_channels": 2, "audio_encoder": "aac", "bframes": 0, "crf": 26, "gop_seconds": 0.5, "preset": "veryfast", "short_side": 540}'


def spec_digest() -> Column:
    """What tells proxies of one contract from those of another; a changed value changes every key."""
    return F.sha2(F.lit(PROXY_SPEC), 256)


def recorded_at(text: Column) -> Column:
    """struct(local, offset) of an ISO date or time: the clock as written, and its seconds ahead of UTC, null if none is named; null as a whole for what is no such text."""
    t = F.trim(text)
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:.(\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?))?(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?$"
    day, clock, zone = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    local = F.concat_ws(" ", day, F.when(clock != "", F.translate(clock, ",", "."))).try_cast("timestamp_ntz")
    digits = F.rpad(F.regexp_replace(zone, r"[^0-9]", ""), 6, "0")
    size = digits.substr(1, 2).try_cast("int") * 3600 + digits.substr(3, 2).try_cast("int") * 60 + digits.substr(5, 2).try_cast("int")
    offset = F.when(zone == "Z", 0).when(zone != "", F.when(zone.startswith("-"), -size).otherwise(size))
    fits = t.rlike(pattern) & ((zone == "") | (clock != "")) & (F.coalesce(F.abs(offset), F.lit(0)) < 86400)
    return F.when(fits & local.isNotNull(), F.struct(local.alias("local"), offset.alias("offset")))


def movie_facts(df: DataFrame, manifest: str = "manifest") -> DataFrame:
    """df with movie: struct(recorded_at in UTC, fingerprint's first 12 signs, chapters in seconds), null without a manifest or if its time names no offset. manifest: struct(written_at, fingerprint, chapters array of struct(name, start_ms))."""
    at = recorded_at(F.col(f"{manifest}.written_at"))
    utc = F.timestamp_add("SECOND", -at["offset"], at["local"])
    chapters = F.transform(f"{manifest}.chapters", lambda c: F.struct(c["name"].alias("name"), (c["start_ms"] / 1000).alias("start")))
    movie = F.struct(utc.alias("recorded_at"), F.substring(F.col(f"{manifest}.fingerprint"), 1, 12).alias("fingerprint"), chapters.alias("chapters"))
    return df.withColumn("movie", F.when(at["offset"].isNotNull(), movie))


#: Fixed value: what the library writes between a failed command's cause and its exit code.
EXITED = ": Command exited "


def _untagged(line: Column) -> Column:
    """A log's line without the groups in square brackets that lead it: the parts up to a closing bracket go as long as each begins with an opening one."""
    parts = F.split(line, "]", -1)
    first = F.array_position(F.transform(parts, lambda p: F.trim(p).startswith("[")), False)
    return F.trim(F.array_join(F.slice(parts, F.greatest(first.cast("int"), F.lit(1)), F.size(parts)), "]"))


def _before_paths(text: Column) -> Column:
    """A text up to the first word that is an absolute path, in quotes or brackets or not; signs that lead to it go, too."""
    words = F.split(text, r"\s", -1)
    bare = F.transform(words, lambda w: F.ltrim(w, F.lit("'\"([=")))
    at = F.array_position(F.transform(bare, lambda w: w.startswith("/") & (F.length(w) > 1) & ~w.startswith("//")), True)
    kept = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), (at - 1).cast("int"))), " ")
    return F.when(at > 0, F.rtrim(kept, F.lit(" :'\"(["))).otherwise(text)


def failure_cause(text: str, path: str) -> Column:
    """The cause in a failure marker, in one line and without paths of the server; null for what is no JSON object with a reason. Of a failed command what stands before its exit code, and the last line of its log that says anything, with the clip's path shortened to its name."""
    v = F.try_parse_json(text)
    reason = F.when(_kind(F.try_variant_get(v, "$.reason", "variant")) == "STRING", F.try_variant_get(v, "$.reason", "string"))
    halves = F.split(reason, "\nstderr:\n", 2)
    said, log = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    first = F.get(F.split(said, "\n", 2), F.lit(0))
    named = lambda c: _before_paths(F.replace(F.replace(c, F.concat(path, F.lit(": ")), F.lit("")), F.col(path), F.substring_index(F.col(path), "/", -1)))
    lines = F.filter(F.transform(F.split(log, "\n"), lambda x: F.trim(F.rtrim(x, F.lit("\r")))), lambda x: x != "")
    gist = named(_untagged(F.try_element_at(lines, F.lit(-1))))
    failed = F.concat_ws(": ", _before_paths(F.substring_index(first, EXITED, 1)), F.nullif(gist, F.lit("")))
    cause = F.when(first.contains(EXITED), failed).otherwise(named(first))
    return F.when(F.trim(reason) != "", F.nullif(cause, F.lit("")))


SORTS = ["datetime", "filename", "custom"]


def legacy_documents(df: DataFrame, text: str) -> DataFrame:
    """df with title, date, location, description, look, method, reverse, custom_order and unmapped: a document of the former format, and in order the paths of what has no place in the present one; a path with :type, :unknown or :unused has a value that cannot be taken. A title 'date - rest' is split as in `dated_title`. Damaged text gives nulls."""
    from ..functions.keys import dated_title

    v = F.col("_v")
    at = lambda path, kind="variant": F.try_variant_get(v, f"$.{path}", kind)
    is_map = lambda path: F.coalesce(_kind(at(path)) == "OBJECT", F.lit(False))
    there = lambda path: F.coalesce(_kind(at(path)) != "VOID", F.lit(False))
    unlike = lambda path: there(path) & ~is_map(path)
    keys = lambda path: F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))
    typed = at("title", "string")
    named = F.try_to_timestamp(at("metadata.date", "string"), F.lit("yyyy-MM-dd")).cast("date")
    split = dated_title(typed, named)
    title = F.when(there("title"), split["title"]).otherwise(at("metadata.title", "string"))
    date = F.when(there("title"), split["date"]).otherwise(named)
    method = F.lower(F.when(there("sort.method"), at("sort.method", "string")).otherwise("datetime"))
    sorted_by = F.when(is_map("sort") & method.isin(*SORTS), method)
    reverse = F.when(sorted_by.isNotNull() & (_kind(at("sort.reverse")) == "BOOLEAN"), at("sort.reverse", "boolean"))
    places = F.when(sorted_by == "custom", at("sort.custom_order", "map<string,variant>"))
    good_places = F.forall(F.map_entries(places), lambda e: (F.trim(e["key"]) != "") & (_kind(e["value"]) == "BIGINT"))
    order = F.when(good_places, F.transform_values(places, lambda _, p: F.try_variant_get(p, "$", "long")))
    said = [
        *(F.when(unlike(p), f"{p}:type") for p in ("metadata", "title_card", "sort")),
        F.when(is_map("sort") & ~method.isin(*SORTS), "sort.method:unknown"),
        F.when(sorted_by.isNotNull() & there("sort.reverse") & reverse.isNull(), "sort.reverse:type"),
        F.when((sorted_by != "custom") & there("sort.custom_order"), "sort.custom_order:unused"),
        F.when((sorted_by == "custom") & there("sort.custom_order") & order.isNull(), "sort.custom_order:type"),
    ]
    none = F.array().cast("array<string>")
    more = F.filter(F.coalesce(keys("$"), none), lambda k: ~k.isin("metadata", "title", "description", "sort", "title_card"))
    inner = F.filter(F.coalesce(keys("$.metadata"), none), lambda k: ~k.isin("title", "date", "location"))
    unmapped = F.array_sort(F.concat(F.array_compact(F.array(*said)), F.transform(inner, lambda k: F.concat(F.lit("metadata."), k)), more))
    look = F.when(is_map("title_card"), F.to_json(at("title_card")))
    x = df.withColumn("_v", F.try_parse_json(text))  # parsed once a row
    return x.withColumns({"title": title, "date": date, "location": at("metadata.location", "string"), "description": at("description", "string"), "look": look, "method": sorted_by, "reverse": reverse, "custom_order": order, "unmapped": F.when(v.isNotNull(), unmapped)}).drop("_v")
