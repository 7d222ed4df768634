"""From raw documents to packed training sequences: quality, lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm import line_dedup, ngram_join, packing, quality
from fairlead.llm.common import free_name
from fairlead.session import shared_dir, stage

CAPACITY = 2048


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too short, repetitive or incompressible ones."""
    return quality.kept_notices(docs, text="text")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one stays; a document that has no word left goes."""
    columns = docs.columns
    cleaned = line_dedup.without_repeated_lines(docs, key="doc_id", text="text")
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays: the smallest doc_id (null last), the first of its rows.

    Rows are told apart by a number of their own, written down with them, so null or
    repeated doc_ids cannot stand for each other.  A document without words is a group of its own.
    """
    own = free_name(docs, "row")
    numbered = stage(docs.withColumn(own, F.monotonically_increasing_id()), "numbered-documents")
    found = ngram_join.similar_notices(numbered, key=own, text="text").select(F.col(own).alias("row"), F.col("component_id").alias("group"))
    ids = numbered.select(F.col(own).alias("row"), "doc_id").join(found, "row")
    # A group of any size is reduced map-side: its smallest doc_id, then the first row that has it.
    least = ids.groupBy("group").agg(F.min("doc_id").alias("least"))
    first = ids.join(least, "group").filter(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("group").agg(F.min("row").alias("kept"))
    return numbered.join(first.select(F.col("kept").alias(own)), own, "left_semi").drop(own)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of CAPACITY tokens."""
    return packing.pack_pieces(packing.checked_pieces(docs, _tokenizer(), CAPACITY, key="doc_id", text="text"), CAPACITY)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", repeated_lines), ("near duplicates", near_duplicates), ("packing", packed_sequences),
]

# SimHash links, components and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
