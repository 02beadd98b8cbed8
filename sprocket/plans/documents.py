"""Registered queries of documents and settings: small tables whose rows the SQL states, and given tables for size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from ..sources import documents as D
from .library import Cases, each
from .queries import query


def _doc(**parts: object) -> str:
    return json.dumps({"version": 0} | parts)


_ONE = {"name": "", "clips": ["k1.mp4", "./sub//k2.mp4"]}
_ROWS: list[tuple[str | None, str | None]] = [
    (_doc(metadata={"title": "Trip", "date": "2024-05-01"}, look={"size": [1, 2]}, chapters=[_ONE, {"name": "Dock", "clips": ["d.mp4"], "card": {"title": "x", "duration": 2, "text_color": "#00ffAA"}}], clips={"sub/k2.mp4": {"rotate": -90, "exclude": True, "trims": [{"in": 0, "out": 1.5, "reason": "black"}]}, "d.mp4": {"title": False}}, ignore=["z.mp4"]), None),
    (_doc(), None), ("junk", "unreadable"), ("[]", "not a mapping"), (None, "unreadable"),
    (json.dumps({"version": 0.0}), "unsupported version"), (json.dumps({"version": False}), "unsupported version"), (json.dumps({}), "unsupported version"),
    (_doc(metadata=[]), "metadata"), (_doc(metadata={"title": 5}), "metadata.title"), (_doc(metadata={"date": "2024-02-30"}), "metadata.date"), (_doc(look="x"), "look"),
    (_doc(chapters={}), "chapters"), (_doc(chapters=[{"clips": []}]), "chapters"), (_doc(chapters=[{"name": "x", "clips": "k"}]), "chapters"),
    (_doc(chapters=[{"name": "x", "card": {"duration": 0.4}}]), "card"), (_doc(chapters=[{"name": "x", "card": {"colour": "red"}}]), "card"), (_doc(chapters=[{"name": "x", "card": {"title": " "}}]), "card"),
    (_doc(chapters=[{"name": "x "}]), "chapter name"), (_doc(chapters=[{"name": "Straße"}, {"name": "STRASSE"}]), "duplicate chapter"),
    (_doc(chapters=[{"name": "x", "clips": ["/k"]}]), "clip name"), (_doc(chapters=[{"name": "x", "clips": ["a/../k"]}]), "clip name"), (_doc(chapters=[{"name": "x", "clips": [5]}]), "clip name"),
    (_doc(chapters=[_ONE], clips={"k1.mp4": {"rotate": 45}}), "clips"), (_doc(chapters=[_ONE], clips={"k1.mp4": {"exclude": 1}}), "clips"), (_doc(chapters=[_ONE], clips={"k1.mp4": {"trims": [{"in": 2, "out": 2}]}}), "clips"),
    (_doc(ignore=["a", "./a"]), "ignore"), (_doc(chapters=[_ONE, {"name": "y", "clips": ["k1.mp4"]}]), "duplicate clip"), (_doc(clips={"q": {}}), "dangling properties"), (_doc(chapters=[_ONE], ignore=["k1.mp4"]), "used and ignored"),
    ('{"version": 0, "metadata": {"title": "\\ud800"}}', "lone surrogate"), ('{"version": 0, "metadata": {"title": "\\ud83d\\ude00 \\\\ud800"}}', None),
]
DOCUMENTS = Cases("id int, json string", *((i, text) for i, (text, _) in enumerate(_ROWS)))
_WANTED = Cases("id int, problem string", *((i, problem) for i, (_, problem) in enumerate(_ROWS)))


@query(f"SELECT id, problem, problem IS NULL AS read FROM {_WANTED.sql}")
def read_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.read_documents(DOCUMENTS.df(spark, sf), "json").select("id", "problem", F.col("doc").isNotNull().alias("read"))


@query(each("SELECT * FROM (VALUES (0, '', 1, 'k1.mp4', NULL, NULL, NULL), (0, '', 2, 'sub/k2.mp4', -90, TRUE, 1), (0, 'Dock', 1, 'd.mp4', NULL, FALSE, 0)) v(id, chapter, pos, clip, rotate, exclude, trims)", id="int"))
def document_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = stored(D.read_documents(DOCUMENTS.df(spark, sf), "json").select("id", "doc"), "documents")
    props = D.clip_properties(docs, "id").select("id", "clip", "rotate", "exclude", F.size("trims").alias("trims"))
    return D.references(docs, "id").join(props, ["id", "clip"], "left")


@query("SELECT conv_id, role AS chapter, CAST(turn AS BIGINT) AS turn FROM conversations UNION ALL SELECT conv_id, '' AS chapter, count(*) FROM conversations GROUP BY 1")
def parsed_references(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each conversation, written as JSON and read again; its second chapter ignores nothing and its clips are the turns."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    clips = F.transform(turns, lambda t: F.concat_ws("-", t["turn"], t["role"]))
    made = c.groupBy("conv_id").agg(F.to_json(F.struct(F.lit(0).alias("version"), F.array(F.struct(F.lit("").alias("name"), clips.alias("clips"))).alias("chapters"))).alias("json"))
    refs = D.references(D.read_documents(made, "json"), "conv_id")
    each = refs.select("conv_id", F.substring_index("clip", "-", -1).alias("chapter"), F.substring_index("clip", "-", 1).cast("long").alias("turn"))
    return each.unionByName(refs.groupBy("conv_id").agg(F.count("*").alias("turn")).select("conv_id", F.lit("").alias("chapter"), "turn"))


SEEDS = Cases("id int, chapter string, pos long, clip string", (0, "", 1, "s"), (1, "", 1, "s"), (90, "", 1, "s"), (90, "Dock", 1, "t"))


@query(each("SELECT * FROM (VALUES (0, '', 1, 'k1.mp4', FALSE), (0, '', 2, 'sub/k2.mp4', FALSE), (0, 'Dock', 1, 'd.mp4', FALSE), (90, '', 1, 's', TRUE), (90, 'Dock', 1, 't', TRUE)) v(id, chapter, pos, clip, seeded)", id="int"))
def loaded_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = stored(D.read_documents(DOCUMENTS.df(spark, sf), "json").select("id", "doc", "problem"), "documents").filter("problem is null")
    return D.with_seeds(D.references(docs, "id"), docs, SEEDS.df(spark, sf), "id")


SETTINGS = Cases("id int, json string", (1, None), (2, '{"layout": "flat", "output": "/o", "look": {"a": 1}, "sort": {"method": "Filename", "reverse": true}}'), (3, "[]"), (4, "x"), (5, '{"look": 3}'), (6, '{"database": {"url": 1}}'), (7, '{"sort": {"method": "size"}}'), (8, "{}"), (9, '{"input": 4}'), (10, '{"sort": {"reverse": 1}}'))


@query(each("SELECT * FROM (VALUES (1, NULL, NULL, 'datetime', FALSE, NULL), (2, 'flat', '/o', 'filename', TRUE, NULL), (3, NULL, NULL, NULL, NULL, 'not a mapping'), (4, NULL, NULL, NULL, NULL, 'unreadable'), (5, NULL, NULL, NULL, NULL, 'look'), (6, NULL, NULL, NULL, NULL, 'database.url'), (7, NULL, NULL, NULL, NULL, 'sort.method'), (8, NULL, NULL, 'datetime', FALSE, NULL), (9, NULL, NULL, NULL, NULL, 'input'), (10, NULL, NULL, NULL, NULL, 'sort.reverse')) v(id, layout, output, method, reverse, problem)", id="int"))
def project_settings(spark: SparkSession, sf: str) -> DataFrame:
    return D.project_settings(SETTINGS.df(spark, sf), "json").select("id", "settings.layout", "settings.output", "settings.method", "settings.reverse", "problem")
