"""Editorial documents and project settings in JSON, read strictly: a bad document keeps its row and says why. Other spellings of the same documents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sidecars import INFINITE, SORTS, _kind

#: The keys of a card, its backgrounds and places, the bounds of its seconds and of its letters' sizes.
CARD_KEYS = "title subtitle duration background font_family title_font_size subtitle_font_size text_color position".split()
BACKGROUNDS, POSITIONS = ["black", "video"], ["center", "top", "bottom"]
CARD_SECONDS, LETTERS = (0.5, 60.0), (8, 400)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, path: str, *kinds: str) -> Column:
    """Whether a value has one of the kinds; NONE stands for no value or a null."""
    k = F.coalesce(_kind(_get(v, path)), F.lit("VOID"))
    return k.isin(*("VOID" if x == "NONE" else x for x in kinds))


def _seconds(v: Column, path: str) -> Column:
    """A finite number that is not negative."""
    t = _get(v, path, "double")
    return _is(v, path, "BIGINT", "DECIMAL", "DOUBLE") & F.coalesce((t >= 0) & (t < INFINITE), F.lit(False))


def clip_name(raw: Column) -> Column:
    """A clip's path within its event without empty and '.' parts; null if it is blank, absolute or leaves the event."""
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    ok = (F.trim(raw) != "") & ~raw.startswith("/") & ~F.array_contains(parts, "..")
    return F.when(ok, F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit(".")))


def _names(items: Column) -> Column:
    """Clips' names in a list of JSON values; null for what is no such name."""
    return F.transform(items, lambda i: F.when(_kind(i) == "STRING", clip_name(F.try_variant_get(i, "$", "string"))))


def _twice(items: Column) -> Column:
    return F.size(F.array_distinct(items)) < F.size(items)


def lone_surrogate(text: Column) -> Column:
    """Whether JSON text holds an escaped half of a pair, which no text in UTF-8 can hold."""
    rest = F.regexp_replace(F.regexp_replace(text, r"\\\\", ""), r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    return rest.rlike(r"\\u[dD][89a-fA-F]")


def _bad_card(card: Column) -> Column:
    there = lambda p: _kind(_get(card, p)).isNotNull()
    text = lambda p: _is(card, p, "STRING") & F.coalesce(F.trim(_get(card, p, "string")) != "", F.lit(False))
    one_of = lambda p, values: _is(card, p, "STRING") & F.coalesce(_get(card, p, "string").isin(values), F.lit(False))
    number = lambda p, kinds, bounds: _is(card, p, *kinds) & F.coalesce(_get(card, p, "double").between(*bounds), F.lit(False))
    rules = {
        "title": text("title"), "subtitle": _is(card, "subtitle", "STRING"), "duration": number("duration", ("BIGINT", "DECIMAL", "DOUBLE"), CARD_SECONDS), "background": one_of("background", BACKGROUNDS),
        "font_family": text("font_family"), "title_font_size": number("title_font_size", ("BIGINT",), LETTERS), "subtitle_font_size": number("subtitle_font_size", ("BIGINT",), LETTERS),
        "text_color": _is(card, "text_color", "STRING") & F.coalesce(_get(card, "text_color", "string").rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False)), "position": one_of("position", POSITIONS),
    }
    bad = F.exists(F.map_keys(F.try_variant_get(card, "$", "map<string,variant>")), lambda k: ~k.isin(CARD_KEYS))
    for p, good in rules.items():
        bad = bad | (there(p) & ~good)
    return (_kind(card) != "VOID") & ((_kind(card) != "OBJECT") | F.coalesce(bad, F.lit(False)))


def _bad_properties(p: Column) -> Column:
    spans = _get(p, "trims", "array<variant>")
    bad_span = lambda s: ~_seconds(s, "in") | ~_seconds(s, "out") | ~F.coalesce(_get(s, "out", "double") > _get(s, "in", "double"), F.lit(False)) | ~_is(s, "reason", "STRING", "NONE")
    turned = _is(p, "rotate", "NONE") | (_is(p, "rotate", "BIGINT") & F.coalesce(_get(p, "rotate", "long") % 90 == 0, F.lit(False)))
    known = _is(p, "title", "BOOLEAN", "NONE") & (_kind(_get(p, "exclude")).isNull() | _is(p, "exclude", "BOOLEAN")) & turned & _is(p, "trims", "ARRAY", "NONE")
    return (_kind(p) != "VOID") & ((_kind(p) != "OBJECT") | ~known | F.coalesce(F.exists(spans, bad_span), F.lit(False)))


def read_documents(df: DataFrame, text: str) -> DataFrame:
    """df with doc and problem: struct(title, date, location, description, look, chapters, clips, ignore) of a document of version 0, or the first rule that it breaks.

    chapters: array of struct(name, clips); clips: map from a clip to its properties; look is JSON. A clip stands in one chapter at most, has properties only if it stands in one, and is ignored only if it does not; names of chapters differ by more than case.
    """
    x = df.withColumn("_v", F.try_parse_json(text))
    v = F.col("_v")
    x = x.withColumns({"_chapters": _get(v, "chapters", "array<variant>"), "_clips": _get(v, "clips", "map<string,variant>"), "_ignore": _names(_get(v, "ignore", "array<variant>"))})
    x = x.withColumn("_parts", F.transform("_chapters", lambda c: F.struct(_get(c, "name", "string").alias("name"), F.coalesce(_names(_get(c, "clips", "array<variant>")), F.array().cast("array<string>")).alias("clips"))))
    # properties are looked up by the clip's plain name
    x = x.withColumn("_props", F.transform(F.map_entries("_clips"), lambda e: F.struct(clip_name(e["key"]).alias("clip"), e["value"].alias("value"))))
    none = F.array().cast("array<string>")
    used = F.coalesce(F.flatten(F.transform("_parts", lambda p: p["clips"])), none)
    names = F.transform("_parts", lambda p: p["name"])
    owners = F.coalesce(F.transform("_props", lambda e: e["clip"]), none)
    ignored = F.coalesce("_ignore", none)
    x = x.withColumns({"_used": used, "_names": names, "_owners": owners, "_ignored": ignored})
    date = _get(v, "metadata.date", "string")
    rules = [
        ("unreadable", v.isNull()),
        ("lone surrogate", lone_surrogate(F.col(text))),
        ("not a mapping", _kind(v) != "OBJECT"),
        ("unsupported version", ~(_is(v, "version", "BIGINT") & F.coalesce(_get(v, "version", "long") == 0, F.lit(False)))),
        ("metadata", ~_is(v, "metadata", "OBJECT", "NONE")),
        *((f"metadata.{p}", ~_is(v, f"metadata.{p}", "STRING", "NONE")) for p in ("title", "location", "description")),
        ("metadata.date", ~_is(v, "metadata.date", "NONE") & ~(_is(v, "metadata.date", "STRING") & F.coalesce(date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & date.try_cast("date").isNotNull(), F.lit(False)))),
        ("look", ~_is(v, "look", "OBJECT", "NONE")),
        ("chapters", ~_is(v, "chapters", "ARRAY", "NONE") | F.exists("_chapters", lambda c: (_kind(c) != "OBJECT") | ~_is(c, "name", "STRING") | ~_is(c, "clips", "ARRAY", "NONE"))),
        ("card", F.exists("_chapters", lambda c: F.coalesce(_bad_card(_get(c, "card")), F.lit(False)))),
        ("chapter name", F.exists("_names", lambda n: (n != F.trim(n)))),
        ("duplicate chapter", _twice(F.transform("_names", F.upper))),
        ("clip name", F.exists("_used", F.isnull) | F.exists("_owners", F.isnull) | F.exists("_ignored", F.isnull)),
        ("clips", ~_is(v, "clips", "OBJECT", "NONE") | F.exists("_props", lambda e: _bad_properties(e["value"]))),
        ("ignore", ~_is(v, "ignore", "ARRAY", "NONE") | _twice(F.col("_ignored"))),
        ("duplicate clip", _twice(F.col("_used"))),
        ("duplicate properties", _twice(F.col("_owners"))),
        ("dangling properties", F.size(F.array_except("_owners", "_used")) > 0),
        ("used and ignored", F.arrays_overlap("_used", "_ignored")),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules))
    x = x.withColumn("problem", problem)

    def properties(p: Column) -> Column:
        trims = F.transform(_get(p, "trims", "array<variant>"), lambda s: F.struct(_get(s, "in", "double").alias("start"), _get(s, "out", "double").alias("end"), _get(s, "reason", "string").alias("reason")))
        return F.struct(_get(p, "title", "boolean").alias("title"), _get(p, "rotate", "long").alias("rotate"), F.coalesce(_get(p, "exclude", "boolean"), F.lit(False)).alias("exclude"), F.coalesce(trims, F.array().cast("array<struct<start:double,end:double,reason:string>>")).alias("trims"))

    clips = F.transform("_props", lambda e: F.struct(e["clip"].alias("clip"), properties(e["value"]).alias("p")))
    doc = F.struct(
        *(_get(v, f"metadata.{p}", "string").alias(p) for p in ("title", "location", "description")), date.try_cast("date").alias("date"),
        F.when(_is(v, "look", "OBJECT"), F.to_json(_get(v, "look"))).alias("look"), F.coalesce("_parts", F.array().cast("array<struct<name:string,clips:array<string>>>")).alias("chapters"), clips.alias("clips"), F.col("_ignored").alias("ignore"),
    )
    return x.select(*df.columns, F.when(F.col("problem").isNull(), doc).alias("doc"), "problem")


# the outer forms keep Spark from testing an array's size below the reader, for which it would read every document again
def chapters(docs: DataFrame, key: str) -> DataFrame:
    """(key, chapter, pos), from 1."""
    x = docs.select(key, F.posexplode_outer("doc.chapters").alias("_i", "_c")).filter("_i is not null")
    return x.select(key, F.col("_c.name").alias("chapter"), (F.col("_i") + 1).cast("long").alias("pos"))


def references(docs: DataFrame, key: str) -> DataFrame:
    """(key, chapter, pos, clip), from 1 in each chapter."""
    x = docs.select(key, F.explode_outer("doc.chapters").alias("_c")).select(key, F.col("_c.name").alias("chapter"), F.posexplode_outer("_c.clips").alias("_i", "clip"))
    return x.filter("_i is not null").select(key, "chapter", (F.col("_i") + 1).cast("long").alias("pos"), "clip")


def clip_properties(docs: DataFrame, key: str) -> DataFrame:
    """(key, clip, title, rotate, exclude, trims)."""
    return docs.select(key, F.explode_outer("doc.clips").alias("_c")).filter("_c is not null").select(key, "_c.clip", "_c.p.*")


def ignored(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode_outer("doc.ignore").alias("clip")).filter("clip is not null")


def with_seeds(refs: DataFrame, documents: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, chapter, pos, clip, seeded): an event's references if it has a document, even an empty one, else those of its seed. documents: key."""
    new = seeds.join(documents.select(key), key, "left_anti")
    return refs.select(key, "chapter", "pos", "clip", F.lit(False).alias("seeded")).unionByName(new.select(key, "chapter", "pos", "clip", F.lit(True).alias("seeded")))


def project_settings(df: DataFrame, text: str) -> DataFrame:
    """df with settings and problem: struct(layout, input, output, look, method, reverse) of a project's settings; no text, or a null, is none set. Parts of another type are problems."""
    v = F.col("_v")
    parts = ["look", "database", "worker", "api", "thumbnails", "proxies", "sort"]
    method = F.lower(F.coalesce(_get(v, "sort.method", "string"), F.lit("datetime")))
    rules = [
        ("unreadable", v.isNull()),
        ("not a mapping", ~_kind(v).isin("OBJECT", "VOID")),
        *((p, ~_is(v, p, "OBJECT", "NONE")) for p in parts),
        *((p, ~_is(v, p, "STRING", "NONE")) for p in ("layout", "input", "output", "database.url")),
        ("sort.method", ~method.isin(SORTS)),
        ("sort.reverse", ~_is(v, "sort.reverse", "BOOLEAN", "NONE")),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules))
    settings = F.struct(*(_get(v, p, "string").alias(p) for p in ("layout", "input", "output")), F.when(_is(v, "look", "OBJECT"), F.to_json(_get(v, "look"))).alias("look"), method.alias("method"), F.coalesce(_get(v, "sort.reverse", "boolean"), F.lit(False)).alias("reverse"))
    x = df.withColumn("_v", F.try_parse_json(F.coalesce(text, F.lit("null"))))
    return x.withColumn("problem", problem).withColumn("settings", F.when(F.col("problem").isNull(), settings)).drop("_v")
