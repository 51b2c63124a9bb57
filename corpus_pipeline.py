"""From documents to training shards: five stages, each over all that its predecessor kept.

1. Quality rules: documents that base thresholds or the learned rules reject go.
2. Near-duplicates (five words a shingle, similarity 0.8 or more): one document of each group stays.
3. Benchmark decontamination: documents that share a window with a benchmark item go.
4. Mixing sources to target weights: documents are left out or repeated as the mix takes them.
5. Sharding: every row of the mix gets a shard and a slot.

All stages but the last return the columns of documents, whatever these are called, and each has its operator's defined results: null and empty texts fail the quality rules;
of rows equal in id and text one stays, and texts under one id are placed each; very long texts are gone through whole; ties go by id or a hash of it; an empty table passes as an
empty one through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, neardup, quality_rules, sharding
from tidemark.llm.common import documents, shared_table, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_report(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The learned rules have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs)
    return docs
