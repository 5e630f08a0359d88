"""A corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark
decontamination, mixing to target weights, sharding.

Every stage takes what its predecessor kept and, but for the last, returns the columns
of ``documents``. The mixture passes over every source once at least, so no document
is lost to it; small sources are repeated, at most twice. The last stage returns where
each row went, read from the files that it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldrec.llm import mixing, postings, queries, repetition, sharding, simhash
from goldrec.plans.durable import durable

MIX = mixing.Mix(repeat=2.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return postings.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.shard_rows(sharding.reshard(docs))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

# XXH64 fingerprints and their components have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
