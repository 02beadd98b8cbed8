"""Keys, names and texts of a library's files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_list(*parts: Column | int | str) -> Column:
    """A JSON list of texts and numbers, with a blank after each comma."""

    def text(c: Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))

    out = [F.lit(str(p)) if isinstance(p, int) else F.lit(f'"{p}"') if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit("["), F.concat_ws(", ", text(out[0]), *out[1:]), F.lit("]"))


def file_key(name: Column, size: Column, mtime_ns: Column, *more: Column | int | str) -> Column:
    """SHA-256 of a file's name, size and time, and of what else its derivative depends on (a version, a digest, a place)."""
    return F.sha2(json_list(name, size.cast("string"), mtime_ns.cast("string"), *more), 256)


def signal(size: Column, mtime_ns: Column) -> Column:
    """What tells a clip from an earlier state of it."""
    return F.struct(size.cast("long").alias("size"), mtime_ns.cast("long").alias("mtime_ns"))


def recorded_output(name: Column) -> Column:
    """Where a recorded movie lies: in its date's year folder, else at the top; null for what is no bare file name."""
    bad = name.isin("", ".", "..") | name.contains("/")
    year = F.regexp_extract(name, r"^(\d{4})-\d{2}-\d{2} - ", 1)
    return F.when(~bad, F.when(year != "", F.concat_ws("/", year, name)).otherwise(name))


def dated_title(title: Column, date: Column) -> dict[str, Column]:
    """title and date of 'YYYY-MM-DD - rest', if that is a real date and the event has none or the same; else both as they are."""
    m = r"^(\d{4}-\d{2}-\d{2}) - (.+)$"
    prefix = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(title, m, 1), F.lit("")), F.lit("yyyy-MM-dd")))
    split = prefix.isNotNull() & (date.isNull() | (date == prefix))
    return {"title": F.when(split, F.regexp_extract(title, m, 2)).otherwise(title), "date": F.when(split, prefix).otherwise(date)}


def quarter_turns(v: Column) -> Column:
    """A rotation that is a multiple of 90; null otherwise."""
    return F.when(v % 90 == 0, v)


def seconds(v: Column) -> Column:
    """A time that is finite and not negative; null otherwise."""
    return F.when((v >= 0) & ~F.isnan(v) & (v < F.lit(float("inf"))), v)


def tool_version(text: Column) -> Column:
    """(major, minor) in a tool's first line."""
    v = r"version n?(\d+)\.(\d+)"
    return F.when(text.rlike(v), F.struct(F.regexp_extract(text, v, 1).cast("int").alias("major"), F.regexp_extract(text, v, 2).cast("int").alias("minor")))


def out_time(line: Column) -> Column:
    """Microseconds of a progress line; null for any other line."""
    return F.nullif(F.regexp_extract(line, r"^out_time_(?:us|ms)=(-?\d+)\s*$", 1), F.lit("")).try_cast("long")


def rotation(tag: Column, matrix: Column) -> Column:
    """Degrees below 360: the tag turns clockwise, the matrix the other way; the tag holds if it is a number."""
    turn = lambda c: F.pmod(F.bround(c.try_cast("double")).cast("long"), F.lit(360))
    return F.coalesce(F.pmod(-turn(tag), F.lit(360)), turn(matrix))


#: Fixed value: the label of a place on a card.
PLACE_LABEL = "Plats"


def subtitle(date: Column, location: Column) -> Column:
    """The default text below an opening card's heading: the day and the labelled place, as far as they are known, a line each."""
    place = F.nullif(F.trim(location), F.lit(""))
    return F.concat_ws("\n", F.date_format(date, "yyyy-MM-dd"), F.when(place.isNotNull(), F.concat(F.lit(f"{PLACE_LABEL}: "), place)))


def metadata_block(name: Column, start_ms: Column, end_ms: Column) -> Column:
    """A chapter of a metadata file."""
    from .scalars import escape_metadata

    return F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), start_ms.cast("string"), F.lit("\nEND="), end_ms.cast("string"), F.lit("\ntitle="), escape_metadata(name), F.lit("\n"))


def changed_since(modified: Column, header: Column) -> Column:
    """Whether a file changed after the second that a header names; an unreadable header counts as yes."""
    said = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.coalesce(F.date_trunc("second", modified) > said, F.lit(True))


def encoder_class(encoder: Column, cpu: tuple[str, ...] = ("libx264", "libx265")) -> Column:
    return F.when(encoder.isin(*cpu), "cpu").otherwise("gpu")


def chapter_refusal(typed: Column, others: Column, reserved: tuple[str, ...] = ("original",)) -> Column:
    """Why a chapter may not bear a name: empty, taken (but for case) or reserved; null if it may. others: array of names."""
    t = F.lower(F.trim(typed))
    return F.when(t == "", "empty").when(F.exists(others, lambda o: F.lower(o) == t), "taken").when(t.isin(*reserved), "reserved")
