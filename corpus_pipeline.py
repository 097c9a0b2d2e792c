"""From raw documents to shards: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before it kept, and returns rows with
the columns of documents; the last adds slot and shard. Nulls, empty texts, repeated rows and empty tables are as
the operators define them. Extra columns of docs pass through whatever their names, but for copy and shuffle_key, which
the mixture overwrites, and slot and shard, which the last stage does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetweave.llm import decontaminate, mixing, neardup, quality, sharding
from assetweave.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labels, rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, likeness 0.8) the least doc_id."""
    return neardup.keep_one(docs)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark items."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, so that sources have their target weights, shuffled."""
    return mixing.replicate(docs).select(*docs.columns)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its slot and shard; copies of a document share a shard."""
    return sharding.place(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", no_benchmark_items),
    ("source mixture", mixed_sources),
    ("sharding", in_shards),
]

#: The classifier and the near-duplicate search can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
