"""Values as canonical JSON text, in column functions: keys in order, escapes for all that is not ASCII, numbers as Python spells them. Two values have one text exactly where they are the same, so its SHA-256 tells them apart, and tools that hash `json.dumps(value, sort_keys=True)` get the same hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {'"': r"\"", "\\": "\\\\", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}


def _escaped(char: Column) -> Column:
    """One character as it stands in a JSON text; beyond 16 bits a pair of escapes."""
    code = F.ascii(char)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    out = F.when(code.between(0x20, 0x7E), char).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
    for plain, short in _SHORT.items():
        out = F.when(char == plain, short).otherwise(out)
    return out


def quoted(s: Column) -> Column:
    """A JSON string. Plain ASCII needs no look at its characters."""
    body = F.when(s.rlike(r"^[ !#-\[\]-~]*$"), s).otherwise(F.array_join(F.transform(F.split(s, ""), _escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def number(x: Column) -> Column:
    """A double as Python writes it: the shortest digits that give it back, an exponent from 1e16 on and below 1e-4. Beyond 1e20 the last of 17 digits is Java's, which errs for one in some ten thousand."""
    return _let(x.cast("double"), lambda v: F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v > 0, "Infinity").otherwise("-Infinity")).otherwise(_let(_digits(v), _placed)))


def _digits(x: Column) -> Column:
    """A spelling of a double with the fewest digits that give it back; Java's has too many at times."""

    def shorter(spelled: Column, form: str) -> Column:
        tried = F.format_string(form, x)
        many = F.length(F.regexp_replace(spelled, r"[eE].*|\D", "")) > int(form[2:-1]) + 1
        return F.when(many & (tried.cast("double") == x), tried).otherwise(spelled)

    plain = x.cast("string")
    usual = _let(plain, lambda s: _let(F.when(F.length(s) < 17, s).otherwise(shorter(s, "%.15e")), lambda t: F.when(F.length(t) < 18, t).otherwise(shorter(t, "%.16e"))))
    # the least numbers of all
    least = F.when(F.format_string("%.0e", x).cast("double") == x, F.format_string("%.0e", x)).when(F.format_string("%.1e", x).cast("double") == x, F.format_string("%.1e", x)).otherwise(plain)

    def large(n: Column) -> Column:
        """Whole numbers of 17 to 19 digits are rounded from their own digits."""
        near = lambda d: F.when(F.abs(x) < 1e17, F.bround(n, d - 17)).when(F.abs(x) < 1e18, F.bround(n, d - 18)).otherwise(F.bround(n, d - 19)).cast("decimal(38,0)")
        return F.when(near(15).cast("double") == x, near(15).cast("string")).when(near(16).cast("double") == x, near(16).cast("string")).when(near(17).cast("double") == x, near(17).cast("string")).otherwise(n.cast("string"))

    return F.when((F.abs(x) >= 1e16) & (F.abs(x) < 9e18), _let(x.cast("long").cast("decimal(38,0)"), large)).when(F.abs(x) < 1e-320, least).otherwise(usual)


def _placed(spelled: Column) -> Column:
    """A number's digits with the point, or the exponent, where Python puts it."""
    part = lambda k: F.regexp_extract(spelled, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([-+]?[0-9]+))?$", k)
    power = F.coalesce(F.nullif(F.regexp_replace(part(4), r"^\+", ""), F.lit("")).cast("int"), F.lit(0))
    both = F.concat(part(2), part(3))
    digits = F.regexp_replace(F.regexp_replace(both, "^0+", ""), "0+$", "")
    # the place of the point, counted from the first digit that is not 0
    place = F.length(part(2)) - F.length(F.regexp_extract(both, "^(0*)", 1)) + power
    sign = F.when(spelled.startswith("-"), "-").otherwise("")

    def put(p: Column) -> Column:
        d, at = p["digits"], p["place"]
        few = F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d)).when(at >= F.length(d), F.concat(d, F.repeat(F.lit("0"), at - F.length(d)), F.lit(".0"))).otherwise(F.concat(F.substr(d, F.lit(1), at), F.lit("."), F.substr(d, at + 1)))
        rest, e = F.substr(d, F.lit(2)), F.abs(at - 1).cast("string")
        long = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.when(at < 1, "e-").otherwise("e+"), F.when(F.length(e) < 2, F.concat(F.lit("0"), e)).otherwise(e))
        return F.concat(p["sign"], F.when(d == "", "0.0").when((at > 16) | (at < -3), long).otherwise(few))

    return _let(F.struct(sign.alias("sign"), digits.alias("digits"), place.alias("place")), put)


def text(value: Column, kind: T.DataType | str, unset: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    """The canonical text of a value of a type. Fields named in unset are left out where they are null; those in raw hold canonical text already."""
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.StringType):
        out = quoted(value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        out = number(value)
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DateType):
        out = quoted(value.cast("string"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: text(x, kind.elementType, unset, raw)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda k: F.concat(quoted(k), F.lit(": "), text(F.try_element_at(value, k), kind.valueType, unset, raw))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            inner = F.coalesce(value[f.name], F.lit("null")) if f.name in raw else text(value[f.name], f.dataType, unset, raw)
            part = F.concat(quoted(F.lit(f.name)), F.lit(": "), inner)
            parts.append(F.when(value[f.name].isNotNull(), part) if f.name in unset else part)
        out = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def digest(value: Column, kind: T.DataType | str, unset: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a value's canonical text."""
    return F.sha2(text(value, kind, unset, raw), 256)


def listed(*parts: tuple[Column, str] | int | str) -> Column:
    """A canonical JSON list of columns with their types, and of fixed texts and numbers."""
    one = lambda p: F.lit(str(p)) if isinstance(p, int) else quoted(F.lit(p)) if isinstance(p, str) else text(p[0], p[1])
    return F.concat(F.lit("["), F.array_join(F.array(*map(one, parts)), ", "), F.lit("]"))


#: The shape in which a document is hashed; look is canonical text.
EDITORIAL = "struct<version:int,metadata:struct<title:string,date:date,location:string,description:string>,look:string,chapters:array<struct<name:string,clips:array<string>>>,clips:map<string,struct<trims:array<struct<in:double,out:double,reason:string>>,title:boolean,rotate:bigint,exclude:boolean>>,ignore:array<string>,poster:struct<clip:string,at:double>>"


def editorial(doc: Column, look: Column, poster: Column | None = None) -> Column:
    """The hash of what a document says, whatever its spelling: doc as `documents.read_documents` gives it, look as canonical text (null: none). Chapters have no cards here."""
    trim = lambda t: F.struct(t["start"].alias("in"), t["end"].alias("out"), t["reason"].alias("reason"))
    props = lambda p: F.struct(F.transform(p["trims"], trim).alias("trims"), p["title"].alias("title"), p["rotate"].alias("rotate"), p["exclude"].alias("exclude"))
    clips = F.map_from_entries(F.transform(F.coalesce(doc["clips"], F.array()), lambda e: F.struct(e["clip"], props(e["p"]))))
    value = F.struct(
        F.lit(0).alias("version"),
        F.struct(*(doc[k].alias(k) for k in ("title", "date", "location", "description"))).alias("metadata"),
        F.coalesce(look, F.lit("{}")).alias("look"),
        doc["chapters"].alias("chapters"),
        F.coalesce(clips, F.create_map().cast("map<string,struct<trims:array<struct<in:double,out:double,reason:string>>,title:boolean,rotate:bigint,exclude:boolean>>")).alias("clips"),
        doc["ignore"].alias("ignore"),
        (F.lit(None).cast("struct<clip:string,at:double>") if poster is None else poster).alias("poster"),
    )
    return digest(value, EDITORIAL, unset=("poster",), raw=("look",))


CLIP_SET = "array<struct<identity:string,signal:struct<size:bigint,mtime_ns:bigint>>>"


def fingerprint(editorial_hash: Column, look_defaults: Column, clip_set: Column, graph: int, tool: tuple[int, int]) -> Column:
    """struct(editorial, defaults, clip_set, engine, combined): hashes of a document, of the defaults' canonical text, of the clips (array of struct(identity, signal), in order) and of the engine, and of them all."""
    engine = digest(F.struct(F.lit(graph).alias("render_graph_version"), F.array(*map(F.lit, tool)).alias("ffmpeg_version")), "struct<render_graph_version:int,ffmpeg_version:array<int>>")
    parts = {"editorial": editorial_hash, "defaults": F.sha2(look_defaults, 256), "clip_set": digest(clip_set, CLIP_SET), "engine": engine}
    whole = F.struct(*(c.alias(k) for k, c in parts.items()))
    return F.struct(*(c.alias(k) for k, c in parts.items()), digest(whole, "struct<editorial:string,defaults:string,clip_set:string,engine:string>").alias("combined"))


def file_key(name: Column, size: Column, mtime_ns: Column, *more: tuple[Column, str] | int | str, first: str | None = None) -> Column:
    """SHA-256 of a file's name in any script, its size and time, and of what else its derivative depends on."""
    head = [first] if first is not None else []
    return F.sha2(listed(*head, (name, "string"), (size, "long"), (mtime_ns, "long"), *more), 256)
