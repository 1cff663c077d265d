"""From raw documents to shards: toxicity, near duplicates, benchmark leaks, mixing, sharding.

``python corpus_pipeline.py IN OUT`` runs the stages over the tables in IN and writes each below OUT.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from netweir.llm import leaks, mixing, sharding, simhash, toxicity
from netweir.llm.common import table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on ``labels`` predicts toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.one_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, repeatedly or not at all, as their sources' weights ask."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("toxicity", clean),
    ("simhash near-dedup", distinct),
    ("benchmark decontamination", unleaked),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Fingerprints, trained models and seeded hashes have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    source, target = sys.argv[1:3]
    rows = table(session, source, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(session, rows, source).write.mode("overwrite").parquet(path := f"{target}/{number}-{name.replace(' ', '-')}")
        rows = session.read.parquet(path)
