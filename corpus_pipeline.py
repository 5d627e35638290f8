"""A corpus pipeline: quality classifier, SimHash near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of documents.

Defined results: null and empty texts are scored, grouped, searched and packed as empty texts; rows with null or
repeated doc_ids are rows like any other; an empty table passes through; columns beyond those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import packing, pii, quality, simhash_wide
from lodestar.llm.common import spread_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component at five-word shingles and a similarity of 0.8: that with the smallest doc_id."""
    return simhash_wide.keep_one(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every personal span replaced by its kind in brackets; ``n_chars`` follows."""
    docs = docs.select(*COLUMNS)
    found = pii.find_spans(docs, pii.train(docs))
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("all_spans")))
    return clean.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of the model's length, with their ids."""
    return packing.with_digest(packing.pack_documents(docs))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_near_duplicates), ("personal_data", without_personal_data), ("packing", packed)]

#: SQL cannot express the trained models, the fingerprints or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared checkpoint folder, read again, and deleted when the
    next one's is written. The last stage's input stays."""
    from lodestar.llm.common import delete_folder, shared_folder

    docs, root = spread_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            delete_folder(spark, f"{root}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
