"""A training corpus from documents, in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprocket.llm import jaccard, mixing, packing, pii, quality
from sprocket.llm.common import written


#: Words in a block of the mix: whole passages, where the query's shorter blocks come nearer to the targets.
MIX_BLOCK = 256
#: Near-duplicates here: shingles of so many words, and the similarity in hundredths (the query op5 has its own).
SHINGLE, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    ids = docs.groupBy("doc_id").count()
    if ids.filter("doc_id is null or count > 1").isEmpty():
        # a table, so that its size is known when the join is planned: texts are dealt out only if it is too large to send
        gone = written(jaccard.join(docs, k=SHINGLE, percent=SIMILAR).filter("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids that do not tell rows apart: number the rows first
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    gone = written(jaccard.join(rows, doc_id="_row", k=SHINGLE, percent=SIMILAR).filter("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "gone")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars, if there is one, counted again."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes; those taken twice come twice."""
    return mixing.mixed_rows(mixing.mix(docs, block=MIX_BLOCK), docs.columns, block=MIX_BLOCK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: Language-neutral SQL has no byte-pair tokenizer and no random field: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
