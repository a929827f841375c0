"""A corpus from raw documents to shards: language ID, n-gram join, decontamination, mixing, sharding.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of `documents`; every stage works on all rows that came to it. Columns
that an operator does not need pass through; nulls, empty texts, repeated rows and empty tables follow the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import decontamination, language_id, mixing, ngram_join, sharding
from readloom.llm.common import giving_back, kept, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learned; those without letters, or in none of them, go."""
    return language_id.accepted(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group that five-word shingle sets of Jaccard similarity 0.8 or more connect."""
    return ngram_join.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lie in benchmark windows."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix that meets the sources' targets, as documents; what is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", duplicates_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express the trained network or the pseudorandom mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes beside its documents goes once they are written, and a stage's documents once the next one's are."""
    docs = table(spark, sf_dir, "documents")
    with giving_back(spark) as stay:
        for name, stage in STAGES[:-1]:
            with giving_back(spark) as own:
                docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
                own.append(docs)
        stay.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
