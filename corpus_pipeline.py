"""Cleaning and packing documents.

Five stages, each over all rows that the one before kept: the quality classifier rejects documents, quality rules reject
more, of near-duplicates (5-word shingles of Jaccard similarity 0.8 or more, directly or over others) the smallest id
stays, personal data is replaced in the texts, and what is left is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm import cnn, neardup, packing, pii, quality_rules
from proxima.llm.common import remove, scratch, table
from proxima.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = cnn.model(docs, table(spark, sf_dir, "labels"))
    return cnn.scored(docs.select(*COLUMNS), net).where(F.col("score") >= 0.3).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs.select(*COLUMNS), words=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", near_dedup), ("pii", redact), ("packing", pack)]

#: SQL cannot express the network, the estimates, the boosted trees or the packing; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order; each result is written to the shared folder and read again, and goes once the next is there."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
