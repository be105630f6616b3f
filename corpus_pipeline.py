"""From raw documents to token ids: quality classifier, exact and near deduplication, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of docs, whatever further columns it has; only doc_id, text and source are read. Null texts are empty, empty texts
are scored and deduplicated like any other and never mixed, null ids and repeated rows are told apart by their texts, and
an empty table passes through every stage as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from cytoloom.llm.common import materialize, table
from cytoloom.shipping import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where labels confirm none."""
    ship(spark)
    return quality_classifier.accepted(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id; a null id is the least."""
    ship(spark)
    return exact_dedup.deduplicated(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least doc_id; one without an id where none has any."""
    ship(spark)
    return simhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn so that each source comes near its target, shard by shard, each shard in its shuffled order; a
    document stands as often as it was drawn. The written partitions are runs of shards."""
    ship(spark)
    plan = mixing.mix(docs, block_words=0)
    return mixing.mixed_documents(plan, docs).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    ship(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_once),
    ("SimHash near-dedup", near_once),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokenised),
]

#: The classifier and the draws have no SQL form; tests/llm/test_pipeline.py holds each stage against a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
    return docs
