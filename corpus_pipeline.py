"""A corpus made ready for training: five stages, each an operator of ``tablewarden.llm`` with its decisions applied.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
``documents``; the last returns the packed pieces. Rows whose doc_id is null or repeated keep their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import exact_dedup, language_id, minhash_forest, packing, suffix_dedup
from tablewarden.llm.common import shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is more likely than not; the others go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the row with the smallest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal texts one document stays, that with the smallest doc_id."""
    return minhash_forest.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id holds; n_chars follows the text."""
    return suffix_dedup.replaced(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

# The model, the signatures and the packing plan are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, made in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        made(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
