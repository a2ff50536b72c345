"""The corpus pipeline: each stage takes what the one before kept, as Parquet.

Toxic documents go, then all but one of each group of near duplicates, then documents that hold
benchmark items; what is left, all of it, is placed in the target mix and laid out in shards.

Each stage handles nulls in any column, empty and very long texts, ties, repeated rows and empty
tables as its operator does. Columns of the documents come through under their names, whatever
they are; a column that a stage adds (mix_slot, shard, slot) gets underscores after its name where
the documents have it already. Each stage's output is removed when the one after it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import decontam, mixing, near_dup, sharding, toxicity
from kinmatch.llm.common import free_name, removed, stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8)."""
    return near_dup.one_of_each(docs, near_dup.NearDup())


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, and mix_slot: in its order a source that has run out leaves its slots to the others."""
    return mixing.mix_sources(docs).select("row.*", F.col("mix_slot").alias(free_name("mix_slot", docs.columns)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, mix_slot, shard and slot."""
    return sharding.shard(docs, carry=True).select("row.*", *(F.col(c).alias(free_name(c, docs.columns)) for c in ("shard", "slot")))


STAGES = [
    ("toxicity", toxic_out),
    ("minhash_near_dedup", near_duplicates_out),
    ("benchmark_decontamination", leaks_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot express the model of the first stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
