"""Sharding by Karmarkar-Karp differencing: near-equal bytes, groups kept whole.

Documents with equal texts form one indivisible group.  Groups are dealt into
blocks of bounded size by their digest; each block is partitioned by the
largest differencing method: the two partial partitions with the largest spread
are combined, the largest subset of one with the smallest of the other.  The
blocks' own partitions are partial partitions again, so the same method
combines them, level by level, until few enough are left for one task.

Only digests, sizes and counts are shuffled, never texts.

Defined cases: a null text has the bytes and the group of an empty one (size
1); rows with equal texts share a shard; rows of a shard are numbered by a hash
cell, then by doc_id (nulls first); an empty table gives an empty result; a group larger than an even share
fills a shard by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hot_size, join_groups, materialize, text_or_empty

SHARDS = 16
#: Groups in a block, and partial partitions that one task combines.
BLOCK = 8192
#: Rows that one numbering task sorts, about.
SLOT_ROWS = 50_000


def difference(vectors: list[np.ndarray] | np.ndarray, shards: int) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    vectors: for each partial partition its ``shards`` subset sums.  Returns for
    each an array that gives the final subset of each of its subsets.
    """
    n = len(vectors)
    out = np.zeros((n, shards), dtype=np.int32)
    if not n:
        return out
    # A node is (sums in descending order, for each position its parts); parts
    # are kept as a tree: node i has children and for each the position taken.
    sums: list[tuple] = []
    tree: list[tuple] = []
    heap = []
    for i, v in enumerate(vectors):
        order = np.argsort(-np.asarray(v), kind="stable").tolist()
        ordered = [int(v[j]) for j in order]
        low = ordered[-1]
        sums.append([x - low for x in ordered])
        tree.append((i, order))
        heap.append((-(ordered[0] - low), i))
    heapq.heapify(heap)
    span = range(shards)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = sums[a], sums[b]
        joined = [sa[k] + sb[shards - 1 - k] for k in span]
        order = sorted(span, key=joined.__getitem__, reverse=True)
        low = joined[order[-1]]
        sums[a] = sums[b] = None
        sums.append([joined[k] - low for k in order])
        tree.append((a, b, order))
        heapq.heappush(heap, (-sums[-1][0], len(sums) - 1))
    # walk down: labels[k] is the final subset of the node's position k
    todo = [(len(tree) - 1, list(span))]
    while todo:
        node, labels = todo.pop()
        t = tree[node]
        if len(t) == 2:
            i, order = t
            for k in span:
                out[i, order[k]] = labels[k]
            continue
        a, b, order = t
        of_a, of_b = [0] * shards, [0] * shards
        for k in span:
            of_a[order[k]] = labels[k]
            of_b[shards - 1 - order[k]] = labels[k]
        todo.append((a, of_a))
        todo.append((b, of_b))
    return out


def _single(sizes: np.ndarray, shards: int) -> np.ndarray:
    v = np.zeros((len(sizes), shards), dtype=np.int64)
    v[:, 0] = sizes
    return v


def _blocks(spark_df: DataFrame, rows: int, key) -> DataFrame:
    n = max(1, -(-rows // BLOCK))
    return spark_df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)))


def _deal_groups(shards: int):
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable")
        to = difference(_single(pdf["bytes"].to_numpy(), shards), shards)[:, 0]
        return pd.DataFrame({"digest": pdf["digest"], "block": pdf["block"], "part": to})

    return deal


def _deal_parts(shards: int):
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.pivot_table(index="child", columns="part", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0)
        to = difference(parts.to_numpy(dtype=np.int64), shards)
        n = len(parts)
        return pd.DataFrame(
            {
                "child": np.repeat(parts.index.to_numpy(), shards),
                "part": np.tile(np.arange(shards, dtype=np.int32), n),
                "block": int(pdf["block"].iloc[0]),
                "to": to.ravel(),
            }
        )

    return deal


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """digest, shard for ``groups`` (digest, bytes): Karmarkar-Karp level by level."""
    n = groups.count()
    dealt = materialize(
        _blocks(groups, n, "digest").groupBy("block").applyInPandas(_deal_groups(shards), "digest binary, block long, part int"),
        "shard-groups",
    )
    # sums of each block's subsets: bounded by shards rows a block
    level = dealt.join(groups, "digest").groupBy("block", "part").agg(F.sum("bytes").alias("bytes")).select(F.col("block").alias("child"), "part", "bytes")
    maps = []
    while True:
        level = materialize(level, "shard-level")
        children = level.select("child").distinct().count()
        step = _blocks(level, children, "child").groupBy("block").applyInPandas(_deal_parts(shards), "child long, part int, block long, to int")
        step = materialize(step, "shard-combined")
        maps.append(step)
        if children <= BLOCK:
            break
        level = step.join(level, ["child", "part"]).groupBy("block", "to").agg(F.sum("bytes").alias("bytes")).select(F.col("block").alias("child"), F.col("to").alias("part"), "bytes")
    where = maps.pop()
    while maps:  # compose the levels from the top; each has 1/BLOCK of the rows of the one below
        below = maps.pop()
        above = where.select(F.col("child").alias("block"), F.col("part").alias("to"), F.col("to").alias("top"))
        where = below.join(above, ["block", "to"]).select("child", "part", F.col("top").alias("to"))
    where = where.select(F.col("child").alias("block"), "part", F.col("to").alias("shard"))
    return dealt.join(where, ["block", "part"]).select("digest", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-sizes")
    placed = materialize(assign_groups(groups.select("digest", "bytes"), shards).join(groups.select("digest", "n"), "digest"), "shard-placed")
    total = rows.count()
    rows = join_groups(rows, placed, ["digest"], "n", total).drop("digest")
    return number(materialize(rows.withColumn("cell", cell_of(total)), "shard-dealt"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cell_of(total: int):
    """A hash of the row; rows of a hot group may be all alike, so they are spread by their place."""
    place = F.when(F.col("n") > hot_size(total), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "size", place), F.lit(max(1, -(-total // SLOT_ROWS)))).cast("int")


def number(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, without a task per shard.

    Rows were dealt into cells; within each shard the cells' counts are
    prefix-summed, and rows are numbered within their cell.
    """
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("cell"))
    starts = counts.select(F.col("shard").alias("s"), F.col("cell").alias("c"), (upto - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("i", within)
    return numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c"))).withColumn(
        "slot", (F.col("start") + F.col("i") - 1).cast("long")
    )
