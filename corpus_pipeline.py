"""A cleaning pipeline over documents: language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back for the next one. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op1_minhash, op2_secrets, op4_packing, op9_language
from quire.llm.catalogue import tokenizer
from quire.llm.shared import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a text that is null, has no letter or is far from every language learned goes."""
    return op9_language.keep_identified(docs, least=op9_language.LEAST)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingle sets are 0.8 similar or more: that of the smallest doc_id, of several the first one.

    Rows are told apart by a number of their own, so that texts under one doc_id, and rows without any, are judged each by itself.
    """
    row = next(name for i in range(len(docs.columns) + 1) if (name := f"row_{i}") not in docs.columns)
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = op1_minhash.near_duplicates(rows, shingle_words=5, percent=80, id_col=row).select(F.col("doc_id").alias("member"), "component_id")
    named = groups.join(rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id")), "member")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "member")).alias("first")).select(F.col("first.member").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    return op2_secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024: a row for each piece, with its ids."""
    return op4_packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("secrets", redacted), ("packing", packed)]
#: Out-of-place distances, structural parsing and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
