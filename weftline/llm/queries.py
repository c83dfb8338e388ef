"""The registered queries of this subpackage: thin wrappers around its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contamination
from .exact_dedup import decisions
from .infill import digests
from .lattice_dedup import near_duplicates as near_vectors
from .merkle import verification
from .mixing import mix_report
from .near_dedup import near_duplicates
from .pii import find
from .quality import score as quality_score
from .shared import table
from .sharding import shard
from .substring_dedup import remove_known
from .suffix_dedup import remove_repeats
from .toxicity import score as toxicity_score


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for the mix of all documents."""
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of the benchmark for every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, keeper and digest of every document."""
    return decisions(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of near-equal bytes."""
    return shard(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 13-word windows of earlier documents."""
    return remove_known(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, parts and digests of every document with its middle moved to the end."""
    return digests(table(spark, sf_dir, "documents"))


def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still fits after tampering."""
    return verification(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lattice_dedup": op12_lattice_dedup,
    "op13_merkle": op13_merkle,
}
