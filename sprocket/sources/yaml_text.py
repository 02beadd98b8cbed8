"""Documents in YAML, read event by event with positions: keys that stand twice, keys that are no text and values that no type can hold become columns, and the rest goes on as JSON to the strict rules of `documents`.

Scalars are typed as YAML 1.2 does, with dates. In the JSON a date is text where a document's date stands and below `look`; elsewhere it is an object with the key `date`, so that a rule that asks for text refuses it.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # without the parser every document is a problem, and says so
    yaml = None

#: Levels of nesting, and nodes that a document's repeated parts may come to.
DEEP, NODES = 200, 200_000
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
_DATE = re.compile(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:(?:[Tt]|[ \t]+)([0-9]{1,2}):([0-9]{2}):([0-9]{2})(\.[0-9]*)?[ \t]*(Z|[-+][0-9]{1,2}(?::?[0-9]{2})?)?)?")
_LONE = re.compile("[\ud800-\udfff]")


class Refused(Exception):
    def __init__(self, code: str, mark: object, detail: str = ""):
        super().__init__(code)
        self.code, self.detail = code, detail
        self.line = getattr(mark, "line", -1) + 1 or None
        self.column = getattr(mark, "column", -1) + 1 or None


def typed(text: str, tag: str | None, plain: bool) -> object:
    """The value of a scalar. A plain one without a tag has the type that its spelling says."""
    kind = (tag or "").rsplit(":", 1)[-1] if tag and tag.startswith("tag:yaml.org,2002:") else None
    if kind == "str" or (not plain and kind is None):
        return text
    if kind in (None, "null") and text in ("", "~", "null", "Null", "NULL"):
        return None
    if kind in (None, "bool") and text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if kind in (None, "int") and _INT.fullmatch(text):
        return int(text, 0) if text[:2] in ("0o", "0x") else int(text)
    if kind in (None, "float"):
        if text.lower() in (".inf", "+.inf", "-.inf"):
            return -math.inf if text[0] == "-" else math.inf
        if text.lower() == ".nan":
            return math.nan
        if _FLOAT.fullmatch(text):
            return float(text)
    if kind in (None, "timestamp") and (m := _DATE.fullmatch(text)):
        day = datetime.date(int(m[1]), int(m[2]), int(m[3]))
        return day if m[4] is None else datetime.datetime.combine(day, datetime.time(int(m[4]), int(m[5]), int(m[6])))
    if kind in ("null", "bool", "int", "float", "timestamp"):
        raise ValueError(kind)
    return text


def kind_of(value: object) -> str:
    return {bool: "boolean", int: "integer", float: "number", type(None): "null", datetime.date: "date", datetime.datetime: "time", str: "text"}.get(type(value), "collection")


class Reader:
    """The value of one document, its events taken one after the other."""

    def __init__(self, text: str):
        self.events = yaml.parse(text, Loader=yaml.SafeLoader)
        self.named: dict[str, object] = {}
        #: (path, kind, line) of keys that are no text
        self.odd_keys: list[dict] = []
        self.nodes = 0

    def document(self) -> object:
        next(self.events)
        first = next(self.events)
        if isinstance(first, yaml.StreamEndEvent):
            return None
        value = self.node(next(self.events), ())
        next(self.events)
        after = next(self.events)
        if not isinstance(after, yaml.StreamEndEvent):
            raise Refused("several documents", after.start_mark)
        return value

    def node(self, event: object, path: tuple[str, ...]) -> object:
        self.nodes += 1
        if len(path) > DEEP or self.nodes > NODES:
            raise Refused("nested too deeply" if len(path) > DEEP else "too large", event.start_mark)
        if isinstance(event, yaml.AliasEvent):
            if event.anchor not in self.named:
                raise Refused("malformed", event.start_mark, "unknown anchor")
            value = self.named[event.anchor]
            self.nodes += value[1] if isinstance(value, tuple) else 0
            return value[0] if isinstance(value, tuple) else value
        began = self.nodes
        if isinstance(event, yaml.ScalarEvent):
            try:
                value: object = typed(event.value, event.tag, event.implicit[0] and event.style is None)
            except (ValueError, OverflowError) as e:
                raise Refused("invalid value", event.start_mark, event.value) from e
        elif isinstance(event, yaml.SequenceStartEvent):
            value = []
            while not isinstance(e := next(self.events), yaml.SequenceEndEvent):
                value.append(self.node(e, (*path, str(len(value)))))
        else:
            value = self.mapping(path)
        if event.anchor:
            self.named[event.anchor] = (value, self.nodes - began)
        return value

    def mapping(self, path: tuple[str, ...]) -> dict:
        out: dict[str, object] = {}
        merged: list[dict] = []
        seen: set[tuple] = set()
        while not isinstance(e := next(self.events), yaml.MappingEndEvent):
            merge = isinstance(e, yaml.ScalarEvent) and e.value == "<<" and e.style is None and e.tag is None
            key = self.node(e, path)
            if isinstance(key, dict | list):
                raise Refused("key is a collection", e.start_mark)
            name = key if isinstance(key, str) else shown(key)
            # 1 and "1" are two keys, 1 and 1 are one
            if (kind_of(key), name) in seen and not merge:
                raise Refused("duplicate key", e.start_mark, name)
            seen.add((kind_of(key), name))
            if not isinstance(key, str):
                self.odd_keys.append({"path": ".".join((*path, name)), "kind": kind_of(key), "line": e.start_mark.line + 1})
            value = self.node(next(self.events), (*path, name))
            if merge:
                parts = value if isinstance(value, list) else [value]
                if not all(isinstance(p, dict) for p in parts):
                    raise Refused("malformed", e.start_mark, "nothing to merge")
                merged += parts
            else:
                out[name] = value
        for part in merged:  # own keys hold, then those of the first part
            for k, v in part.items():
                out.setdefault(k, v)
        return out


def shown(value: object) -> str:
    return value if isinstance(value, str) else value.isoformat() if isinstance(value, datetime.date) else json.dumps(value)


def _plain(value: object, path: tuple[str, ...]) -> object:
    if isinstance(value, dict):
        return {k: _plain(v, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v, path) for v in value]
    if isinstance(value, datetime.date):
        return value.isoformat() if path == ("metadata", "date") or path[:1] == ("look",) else {"date": value.isoformat()}
    if isinstance(value, float) and not math.isfinite(value):
        return {"number": str(value)}
    return value


def read(text: bytes | None) -> dict:
    """{json, problem, line, column, detail, odd_keys} of one text."""
    out: dict = {"json": None, "problem": None, "line": None, "column": None, "detail": None, "odd_keys": []}
    if text is None:
        return out | {"problem": "absent"}
    if yaml is None:
        return out | {"problem": "no parser"}
    try:
        plain = text.decode("utf-8")
    except UnicodeDecodeError as e:
        return out | {"problem": "not UTF-8", "detail": str(e.start)}
    reader = None
    try:
        reader = Reader(plain)
        value = reader.document()
        if value is None:
            raise Refused("empty", None)
        tree = _plain(value, ())
        whole = json.dumps(tree, ensure_ascii=False)
        if _LONE.search(whole):
            raise Refused("lone surrogate", None)
        return out | {"json": whole, "odd_keys": reader.odd_keys}
    except Refused as e:
        return out | {"problem": e.code, "line": e.line, "column": e.column, "detail": e.detail or None}
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        return out | {"problem": "malformed", "line": None if mark is None else mark.line + 1, "column": None if mark is None else mark.column + 1, "detail": getattr(e, "problem", None)}
    except RecursionError:
        return out | {"problem": "nested too deeply"}


_FIELDS = pa.struct([("json", pa.string()), ("problem", pa.string()), ("line", pa.int64()), ("column", pa.int64()), ("detail", pa.string()), ("odd_keys", pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("line", pa.int64())])))])
_DDL = "struct<json:string,problem:string,line:bigint,column:bigint,detail:string,odd_keys:array<struct<path:string,kind:string,line:bigint>>>"


def parse(df: DataFrame, text: str) -> DataFrame:
    """df with yaml: struct(json, problem, line, column, detail, odd_keys) of each document. text: text or bytes."""
    names = [c for c in df.columns if c != "yaml"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _FIELDS)], [*names, "yaml"])

    return df.select(*names, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"{kinds}, yaml {_DDL}")


def read_documents(df: DataFrame, text: str) -> DataFrame:
    """df with doc, problem, line and column: documents of version 0 by the rules of `documents.read_documents`, after those of the text itself. Below `look` every key is text."""
    from . import documents

    x = parse(df, text).withColumn("_json", F.col("yaml.json"))
    read_ = documents.read_documents(x, "_json")
    odd = F.get(F.filter("yaml.odd_keys", lambda k: k["path"].startswith("look.")), F.lit(0))
    said = F.coalesce(F.col("yaml.problem"), F.when(F.col("problem").isNull() | ~F.col("problem").isin("not a mapping", "unsupported version"), F.when(odd.isNotNull(), "look key")), F.col("problem"))
    y = read_.withColumn("_said", said)
    return y.select(
        *df.columns,
        F.when(F.col("_said").isNull(), F.col("doc")).alias("doc"),
        F.col("_said").alias("problem"),
        F.when(F.col("yaml.problem").isNotNull(), F.col("yaml.line")).when(F.col("_said") == "look key", odd["line"]).alias("line"),
        F.when(F.col("yaml.problem").isNotNull(), F.col("yaml.column")).alias("column"),
    )


def project_settings(df: DataFrame, text: str) -> DataFrame:
    """df with settings and problem: a project's settings in YAML by the rules of `documents.project_settings`; an empty text sets nothing."""
    from . import documents

    x = parse(df, text).withColumn("_json", F.when(F.col("yaml.problem").isin("empty", "absent"), "null").otherwise(F.col("yaml.json")))
    read_ = documents.project_settings(x, "_json")
    said = F.when(F.col("yaml.problem").isin("empty", "absent"), F.col("problem")).otherwise(F.coalesce(F.col("yaml.problem"), F.col("problem")))
    return read_.withColumn("_said", said).select(*df.columns, F.when(F.col("_said").isNull(), F.col("settings")).alias("settings"), F.col("_said").alias("problem"))
