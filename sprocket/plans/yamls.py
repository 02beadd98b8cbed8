"""Registered queries of YAML documents and of edits in their text: a document for each conversation, odd ones among them, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..session import table
from ..sources import yaml_text
from .queries import query


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(event, text): a chapter for each role of a conversation, a clip for each turn; every eleventh document in another way of no use."""
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn").distinct()
    clips = c.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    chapter = F.concat(F.lit("  - name: "), F.col("role"), F.lit("\n    clips:\n"), F.array_join(F.transform("turns", lambda t: F.concat(F.lit("      - "), F.col("role"), F.lit("/"), t.cast("string"), F.lit(".mp4   # turn\n"))), ""))
    docs = clips.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", chapter.alias("text")))).alias("chapters"))
    k = F.col("conv_id")
    head = F.concat(F.lit("# written by hand\nversion: 0\nmetadata:\n  title: 'Talk "), k, F.lit("'   # a title\n  date: 2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-07\n"))
    body = F.concat(head, F.lit("chapters:\n"), F.array_join(F.transform("chapters", lambda x: x["text"]), ""))
    odd = {
        1: F.concat(body, F.lit("version: 0\n")),
        2: F.concat(body, F.lit("look: {2024-01-01: x}\n")),
        3: F.regexp_replace(body, "date: 2024-", "date: 2024-02-3"),
        4: F.concat(body, F.lit("look: [1, 2\n")),
        5: F.lit("- a\n- b\n"),
        6: F.lit("# nothing\n"),
        7: F.regexp_replace(body, "version: 0", "version: false"),
        8: F.concat(body, F.lit("look: {font: *none}\n")),
        9: F.concat(body, F.lit("look: &l {font: a, sizes: [1, 2.5, 0x10, ~, yes]}\nsort: *l\n")),
        10: F.regexp_replace(body, "title: 'Talk [0-9]+'", "title: 2024-01-05"),
    }
    text = body
    for n, t in odd.items():
        text = F.when(k % 11 == n, t).otherwise(text)
    return docs.select(k.alias("event"), text.alias("text"))


_ODD = "CASE event % 11 WHEN 1 THEN 'duplicate key' WHEN 2 THEN 'look key' WHEN 3 THEN 'metadata.date' WHEN 4 THEN 'malformed' WHEN 5 THEN 'not a mapping' WHEN 6 THEN 'empty' WHEN 7 THEN 'unsupported version' WHEN 8 THEN 'malformed' WHEN 10 THEN 'metadata.title' END"
_TALKS = "t AS (SELECT conv_id AS event, count(DISTINCT role) AS roles, count(*) AS clips FROM (SELECT DISTINCT conv_id, role, turn FROM conversations) GROUP BY 1)"


@query(f"""WITH {_TALKS} SELECT event, {_ODD} AS problem, CASE event % 11 WHEN 1 THEN 7 + 2 * roles + clips WHEN 2 THEN 7 + 2 * roles + clips END AS line,
CASE WHEN {_ODD} IS NULL THEN 'Talk ' || event END AS title, CASE WHEN {_ODD} IS NULL THEN make_date(2024, CAST(event % 12 + 1 AS INTEGER), 7)::VARCHAR END AS date, CASE WHEN {_ODD} IS NULL THEN roles END AS n_chapters,
CASE WHEN event % 11 = 9 THEN '{{"font":"a","sizes":[1,2.5,16,null,"yes"]}}' END AS look FROM t""")
def yaml_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = yaml_text.read_documents(documents(spark, sf), "text")
    return d.select("event", "problem", F.when(F.col("problem").isin("duplicate key", "look key"), F.col("line")).alias("line"), "doc.title", F.col("doc.date").cast("string").alias("date"), F.size("doc.chapters").alias("n_chapters").cast("long").alias("n_chapters"), "doc.look").withColumn("n_chapters", F.when(F.col("problem").isNull(), F.col("n_chapters")))


@query(f"""WITH {_TALKS}, c AS (SELECT DISTINCT conv_id AS event, role AS chapter, turn FROM conversations WHERE conv_id % 11 IN (0, 9))
SELECT event, chapter, row_number() OVER (PARTITION BY event, chapter ORDER BY turn) AS pos, chapter || '/' || turn || '.mp4' AS clip FROM c""")
def yaml_references(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import documents as D

    return D.references(yaml_text.read_documents(documents(spark, sf), "text"), "event")


@query(f"""WITH {_TALKS} SELECT event, CASE WHEN event % 11 IN (1, 4, 8) THEN CASE event % 11 WHEN 1 THEN 'duplicate key' ELSE 'malformed' END WHEN event % 11 = 5 THEN 'no such place' WHEN event % 5 = 3 THEN 'nothing there' END AS problem,
CASE WHEN event % 11 IN (1, 4, 5, 8) OR event % 5 = 3 THEN 0 WHEN event % 11 = 6 THEN length('metadata: {{title: "New: title"}}' || chr(10) || 'ignore: [extra.mp4]' || chr(10))
ELSE CASE WHEN event % 11 = 10 THEN length('"New: title"') - length('2024-01-05') ELSE length('"New: title"') - length('''Talk ' || event || '''') END + length(chr(10) || 'ignore: [extra.mp4]') END AS longer,
CASE WHEN event % 11 IN (1, 4, 5, 8) OR event % 5 = 3 THEN TRUE ELSE event % 11 <> 6 END AS keeps_comments FROM t""")
def patched_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A new title and a new list in every document; every fifth asks for something to go that is not there."""
    docs = documents(spark, sf)
    edit = lambda n, op, path, value: F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), F.array(*map(F.lit, path)).alias("path"), F.lit(value).alias("value"))
    edits = docs.select("event", F.explode(F.array_compact(F.array(edit(1, "set", ["metadata", "title"], '"New: title"'), edit(2, "append", ["ignore"], '"extra.mp4"'), F.when(F.col("event") % 5 == 3, edit(3, "remove", ["metadata", "place"], None))))).alias("e")).select("event", "e.*")
    new = patches.patch(docs.withColumn("old", F.col("text")), edits, "event")
    # every line but that of the title is as it was
    kept = F.forall(F.filter(F.split("old", "\n"), lambda x: ~x.contains("title") & (x != "")), lambda x: F.array_contains(F.split("text", "\n"), x))
    keeps = kept & F.when(F.col("old").contains("# a title"), F.col("text").contains("# a title") & F.col("text").startswith("# written by hand")).otherwise(F.col("text") == F.col("old"))
    return new.select("event", "problem", (F.length("text") - F.length("old")).cast("long").alias("longer"), keeps.alias("keeps_comments"))
