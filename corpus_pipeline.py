"""From raw documents to packed training sequences: STAGES in order, each written as Parquet and read again by the next.

A document that the quality classifier rejects goes; of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest
doc_id stays; personal data is replaced by its kind; documents are mixed to target weights (a document comes once for each
epoch that takes it); what is left is packed. Nulls, empty texts, repeated rows and extra columns: as the operators say; rows with a
null doc_id go by their text in the first two stages: they are classified and linked like others, under a stand-in for the id; of
those with the same text one stays, and none where a document with an id is alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import importance, minhash, mixing, packing, pii
from ledgerframe.llm.common import cut, shared_folder, table
from ledgerframe.sources import folders

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: doc_id or, where that is null, a hash of the text that is larger than all doc_ids below 2^62."""
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document the importance resampling keeps."""
    docs = keyed(docs)
    told = importance.classify(docs.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "labels"))
    kept = told.where("kept").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(kept, "key", "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    told = minhash.near_duplicates(docs.select(F.col("key").alias("doc_id"), "text"), SHINGLE)
    gone = cut(told.where("not kept").select(F.col("doc_id").alias("key")).distinct())
    named = docs.where("doc_id is not null").join(gone, "key", "left_anti").select(COLUMNS)
    unnamed = docs.where("doc_id is null").join(gone, "key", "left_anti")
    return named.union(unnamed.groupBy("text").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing_to_weights", mixed),
    ("best_fit_packing", packed),
]
#: Importance resampling and near-duplicates have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:  # what the stage before left is no longer needed
            folders.delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
