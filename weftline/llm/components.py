"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges; its result is
written to the shared folder, so lineage stays short and lost executors cost
one round at most.  A node that most edges share is split over several tasks.
Nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_split, materialize


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return (r[0], r[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for all nodes of ``edges`` (a, b: long).

    Loops are ignored, repeated edges do no harm, no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc-edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_split(both.where("v > u"), low, "u", ["v"], state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_split(large, low, "u", ["v"], state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), "cc-round")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
