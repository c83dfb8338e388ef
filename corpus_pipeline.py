"""The corpus pipeline: five stages, each written as Parquet and read by the next.

toxicity (toxic documents go), near-dedup (one document of each group stays),
decontamination (contaminated documents go), mixing (documents are taken as
often as their source's budget says), sharding (the rows that are left, with
their shard and slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.decontamination import remove_contaminated
from weftline.llm.mixing import expand, mix
from weftline.llm.near_dedup import deduplicate
from weftline.llm.shared import materialize, table
from weftline.llm.sharding import shard
from weftline.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return expand(mix(docs), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Neither the trained classifier nor the differencing method is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
