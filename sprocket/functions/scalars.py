"""Scalar functions as column expressions. `fold` alone needs Python, as no built-in has full Unicode case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a title keeps in lower case unless they come first.
SMALL_WORDS = "och eller men utan av på i för till från med över under vid genom mot om åt ur and or but the a an in on at to for of with by".split()


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def fold(s: Column | str) -> Column:
    """NFC, then full case folding; null stays null. Only texts that are not ASCII are looked at in Python."""
    c = F.col(s) if isinstance(s, str) else s
    plain = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.coalesce(F.when(plain, F.lower(c)), _fold(F.when(~plain, c)))


def natural_key(name: Column) -> Column:
    """Sorts digit runs as numbers, of any length, and before text, text by lower case. An array of structs compares as wanted."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"))
    number = lambda p: F.when(p.rlike("^[0-9]"), F.regexp_replace(p, "^0+(?=[0-9])", ""))
    # of two numbers the one with more digits is greater
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]"), 0).otherwise(1).alias("tag"), F.length(number(p)).alias("digits"), number(p).alias("number"), F.when(p.rlike("^[^0-9]"), p).alias("text")))


def rational(s: Column) -> Column:
    """'n/d' as a double; null without a slash, if either side is no number or d is 0."""
    num, den = F.trim(F.substring_index(s, "/", 1)), F.trim(F.substr(s, F.instr(s, "/") + 1))
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    ok = s.contains("/") & num.rlike(number) & den.rlike(number)
    return F.when(ok & (den.try_cast("double") != 0), num.try_cast("double") / den.try_cast("double"))


def frame_rate(average: Column, rate: Column) -> Column:
    """The average rate if it is plausible, else the base rate if that is."""
    a, r = rational(average), rational(rate)
    good = lambda x: (x > 0) & (x <= 1000)
    return F.when(good(a), a).when(good(r), r)


def duration(container: Column, stream: Column) -> Column:
    return F.coalesce(container.try_cast("double"), stream.try_cast("double"), F.lit(0.0))


def turn(rotation: Column, extra: Column) -> Column:
    """Clockwise quarter turns for display, and an edit's own on top, in degrees below 360."""
    return F.pmod(F.pmod(F.lit(360) - rotation, F.lit(360)) + extra, F.lit(360))


def even(v: Column) -> Column:
    """The nearest even number, halves up, at least 2."""
    return F.greatest(F.lit(2), F.floor(v / 2 + 0.5) * 2).cast("long")


def gop(fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(fps * 0.5).cast("long"))


def filmstrip(seconds: Column, most: int = 120, columns: int = 10) -> dict[str, Column]:
    """interval, tiles, columns and rows of a strip of at most `most` tiles."""
    interval = F.greatest(F.lit(1), F.ceil(seconds / most)).cast("long")
    tiles = F.greatest(F.lit(1), F.ceil(seconds / interval)).cast("long")
    return {"interval": interval, "tiles": tiles, "strip_columns": F.least(tiles, F.lit(columns)).cast("long"), "strip_rows": F.ceil(tiles / columns).cast("long")}


def name_parts(folder: Column) -> dict[str, Column]:
    """date, title and location of '[date - ]title[ - location]', and problems, in order; never an error. A year alone is no date; the last part of several is the location."""
    f = F.trim(folder)
    token = F.regexp_extract(f, r"^(\d{4}(?:-\d{2}-\d{2})?)(?:\s*-\s*|$)", 1)
    date = F.to_date(F.try_to_timestamp(F.when(F.length(token) == 10, token), F.lit("yyyy-MM-dd")))
    rest = F.btrim(F.when(token != "", F.regexp_replace(f, r"^\d{4}(-\d{2}-\d{2})?(\s*-\s*|$)", "")).otherwise(f), F.lit(" -"))
    parts = F.split(rest, r"\s+-\s+")
    last = F.size(parts) - 1
    blank = lambda c: F.nullif(c, F.lit(""))
    title = blank(title_case(F.when(last > 0, F.array_join(F.slice(parts, 1, F.greatest(last, F.lit(1))), " - ")).otherwise(rest)))
    location = F.when(last > 0, blank(title_case(F.get(parts, last))))
    problems = F.array_compact(F.array(F.when(token == "", "no-date").when(F.length(token) == 4, "year-only").when(date.isNull(), "impossible-date"), F.when(title.isNull(), "no-title")))
    return {"event_date": date, "title": title, "location": location, "problems": problems}


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, r"[/\\\x00-\x1f\x7f]", "-")


def output_name(date: Column, title: Column, location: Column) -> Column:
    """'[date - ]title[ - location].mp4'; without a title it is Untitled, and a blank location adds nothing."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.concat_ws(" - ", date, F.coalesce(blank(safe_name(title)), F.lit("Untitled")), blank(safe_name(location))), F.lit(".mp4"))


def output_path(date: Column, title: Column, location: Column) -> Column:
    """The name below its year's folder; an undated one at the top."""
    return F.concat_ws("/", F.date_format(date, "yyyy"), output_name(F.date_format(date, "yyyy-MM-dd"), title, location))


def title_case(s: Column) -> Column:
    """Words capitalised, the rest of each in lower case; small words and those that begin with a digit in lower case, but for the first."""
    small = F.array(*(F.lit(w) for w in SMALL_WORDS))

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        bare = F.regexp_replace(low, r"[^\p{L}\p{N}_]", "")
        return F.when((i > 0) & (bare.rlike("^[0-9]") | F.array_contains(small, bare)), low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, 2, 1 << 20)))

    return F.array_join(F.transform(F.split(F.trim(s), r"\s+"), word), " ")


def entity_tag(size: Column, mtime_ns: Column) -> Column:
    return F.concat_ws("-", F.lower(F.hex(size)), F.lower(F.hex(mtime_ns)))


def cache_key(identity: Column) -> Column:
    return F.concat(F.substring(F.sha2(identity, 256), 1, 16), F.lit(".json"))


def escape_metadata(s: Column) -> Column:
    return F.regexp_replace(s, r"([=;#\\\n])", r"\\$1")


#: Fixed value: seconds, m:ss or h:mm:ss, then an optional fraction after a point or a comma.
TIME = r"^(?:(\d+):([0-5]\d):([0-5]\d)|(\d+):([0-5]\d)|(\d+))(?:[.,](\d+))?$"


def parse_time(s: Column) -> Column:
    """A typed time in milliseconds; null if it is refused."""
    t = F.trim(s)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, TIME, k), F.lit("")).try_cast("long"), F.lit(0))
    seconds = (part(1) * 60 + part(2)) * 60 + part(3) + part(4) * 60 + part(5) + part(6)
    return F.when(time_refusal(s).isNull() & s.isNotNull(), seconds * 1000 + F.rpad(F.regexp_extract(t, TIME, 7), 3, "0").cast("long"))


def time_refusal(s: Column) -> Column:
    """Why a typed time is refused: empty, unreadable (more than twelve digits of hours, minutes or seconds among it) or too-precise (more than three decimals); null if it is not."""
    t = F.trim(s)
    return F.when(t == "", "empty").when(~t.rlike(TIME) | t.rlike(r"^\d{13}"), "unreadable").when(F.length(F.regexp_extract(t, TIME, 7)) > 3, "too-precise")


def format_time(ms: Column) -> Column:
    """m:ss or h:mm:ss with the fraction's digits, no zero last; null for a time before 0."""
    s = F.floor(ms / 1000)
    clock = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    return F.when(ms >= 0, F.concat(clock, F.regexp_replace(F.concat(F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")), r"\.?0*$", "")))


def nearest_frame(t: Column, fps: Column) -> Column:
    return F.floor(t * fps + 0.5) / fps


def split_head(window: Column, fps: Column, length: Column, least: float = 1.0) -> Column:
    """Where a segment is split: the first frame at or after window, null if less than `least` seconds would remain."""
    at = F.ceil(window * fps) / fps
    return F.when(length - at >= least, at)


def needs_pad(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Whether shapes differ, in exact integers."""
    return width.cast("long") * to_height.cast("long") != height.cast("long") * to_width.cast("long")


def pixel_format(fmt: Column) -> dict[str, Column]:
    depth = F.regexp_extract(fmt, r"^yuvj?4(?:20|22|44)p(\d*)", 1)
    known = fmt.rlike(r"^yuvj?4(20|22|44)p")
    return {"depth": F.when(known, F.coalesce(F.nullif(depth, F.lit("")).cast("int"), F.lit(8))), "is_420": F.when(known, fmt.rlike(r"^yuvj?420p"))}


def etag_matches(header: Column, tag: Column) -> Column:
    """Weak comparison over a comma list; '*' matches anything, no header nothing."""
    tags = F.transform(F.split(header, ","), lambda t: F.regexp_replace(F.trim(t), r'^W/|"', ""))
    return F.coalesce(F.array_contains(tags, "*") | F.array_contains(tags, F.regexp_replace(tag, r'^W/|"', "")), F.lit(False))


def progress(micros: Column, seconds: Column, ended: Column) -> Column:
    return F.when(ended, F.lit(1.0)).when(seconds > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), micros / 1e6 / seconds)))


def changed_fields(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that differ, blank and null being alike."""
    clean = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.array_compact(F.array(*(F.when(~clean(a[k]).eqNullSafe(clean(b[k])), F.lit(k)) for k in a)))
