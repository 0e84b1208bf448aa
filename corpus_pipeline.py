"""A training-data pipeline over `documents`, each stage one operator."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cloakframe.llm import language, lines, minhash, packing, shared  # noqa: E402
from cloakframe.llm.tokens import default_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents in which none is found go (null, empty or letterless texts)."""
    shared.small_batches(spark)
    found = language.predict(docs, language.train(docs))
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line; every document stays, n_chars follows its text."""
    return lines.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, on shingles of five words."""
    shared.small_batches(spark)
    return minhash.keep_one(docs.select(COLUMNS), minhash.Settings(words=5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    shared.small_batches(spark)
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"))


STAGES = [("language_id", languages), ("line_dedup", unique_lines), ("minhash_dedup", unique_documents), ("packing", packed)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; all but the last are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
