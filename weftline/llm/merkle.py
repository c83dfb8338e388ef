r"""A Merkle manifest of a dataset, one tree per source below a common root.

Every row is a leaf: the digest of its fields.  The leaves of a source ascend by
doc_id; every FAN consecutive nodes become one of the next level until one is
left, the source's subroot, and the subroots make the root in the same way.

Levels are windows: nodes are partitioned by group and parent place, and an
ordered collect_list over the full frame of at most FAN rows gives each node
both the preimage of its parent and its own siblings; the first row of each run
stands for the parent on the next level.  A partition never holds more than FAN
rows, whatever the size of a source.  Proofs go the other way: each level joins
its windows with the proofs of the level above, so a leaf gets the whole path in
one join with a table of a sixteenth of its rows.

Places come from a range partitioning by source, doc_id and leaf, where equal
rows are told apart by a row number, so that one source, or one row that repeats,
is spread over tasks.  What reaches the driver is the number of rows of the
largest source, of sources, and the root.

Defined cases: nulls are "-", empty texts "0:"; a null source is a group of its
own, before all others; a null doc_id comes first and is never tampered with;
rows that repeat a doc_id are ordered by their digest; equal rows are leaves of
their own; other columns aren't part of a leaf; an empty table has no root and
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, join_groups, materialize

#: Nodes under one parent.
FAN = 16
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = "array<struct<l:string,r:string>>"
#: Bits of monotonically_increasing_id() that count the rows of a partition.
_ROWS = 33


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length before it; "-" for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """Digest of a row's fields; ``text`` takes the place of its text."""
    return digest(F.concat(*[field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]))


def tampered_leaf() -> Column:
    """Digest of the row with A-Z in its text as small letters, for one doc_id in five; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf_of(F.translate("text", UPPER, LOWER)))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, written in the order of the columns ``order``, with their ``place`` from 0."""
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    in_order = tie.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # numbers of a sorted partition ascend, and so do partitions
    at = materialize(in_order.withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("_at", _ROWS)
    # one row per partition of the shuffle
    before = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROWS) - 1))).drop("_part", "_at", "_before")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's place, the run of digests below it, and their own siblings to the left and right."""
    run = Window.partitionBy("k", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = nodes.withColumn("parent", F.expr(f"idx div {FAN}")).withColumn("run", F.collect_list("hash").over(run))
    at = F.pmod("idx", F.lit(FAN)).cast("int")
    beside = F.struct(
        F.array_join(F.slice("run", F.lit(1), at), "").alias("l"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("r")
    )
    return out.withColumn("beside", beside)


def grow(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``nodes`` (k, idx, n, hash; n nodes of group k), and the digest (k, top) of each group's last node."""
    levels = [nodes]
    tops = nodes.where("n = 1").select("k", F.col("hash").alias("top"))
    while largest > 1:
        first = _runs(levels[-1].where("n > 1")).where(f"idx % {FAN} = 0")
        up = first.select("k", F.col("parent").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), digest(F.array_join("run", "")).alias("hash"))
        levels.append(materialize(up, "merkle-level"))
        tops = tops.unionByName(levels[-1].where("n = 1").select("k", F.col("hash").alias("top")))
        largest = -(-largest // FAN)
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with ``path``, the siblings from its own level up, and what ``tops`` (k, path, ...) say of its group."""
    said = [c for c in tops.columns if c not in ("k", "path")]
    above = None
    for level in reversed(levels):
        out = level.where("n = 1").join(tops, "k").select(*level.columns, "path", *said)
        if above is not None:
            up = above.select("k", F.col("idx").alias("parent"), "path", *said)
            inner = _runs(level.where("n > 1")).join(up, ["k", "parent"])
            out = out.unionByName(inner.select(*level.columns, F.concat(F.array("beside"), "path").alias("path"), *said))
        above = out if level is levels[0] else materialize(out.select("k", "idx", "path", *said), "merkle-paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest(F.concat(x["l"], node, x["r"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, as one string."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def manifest(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """doc_id, source, place in its source, leaf, other, subroot, path and root for every row of ``docs``.

    other: a further value of the row, computed in the scan that hashes it.
    """
    other = F.lit(None).cast("string") if other is None else other
    k = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    leaves = materialize(docs.select("doc_id", "source", k.alias("k"), leaf_of().alias("hash"), other.alias("other")), "merkle-leaves")
    leaves = placed(leaves, "source", "doc_id", "hash")
    sources = materialize(leaves.groupBy("k", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    groups, total, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    facts = sources.select("k", "first", "n")
    # as many rows as sources; beyond the bound a join that splits large sources
    leaves = leaves.join(F.broadcast(facts), "k") if groups <= BROADCAST_ROWS else join_groups(leaves, facts, ["k"], "n", total)
    nodes = leaves.select("k", (F.col("place") - F.col("first")).alias("idx"), "n", "hash", "doc_id", "source", "other")
    levels, tops = grow(nodes, largest)

    of_sources = placed(tops.join(sources.select("k", "source"), "k").select("k", "source", "top"), "source")
    of_sources = of_sources.select(F.lit("").alias("k"), F.col("place").alias("idx"), F.lit(groups).cast("long").alias("n"), F.col("top").alias("hash"), F.col("k").alias("of"))
    upper, top = grow(of_sources, groups)
    root = top.head()
    top = top.select("k", F.array().cast(_PATH).alias("path"))
    tops = descend(upper, top).select(F.col("of").alias("k"), "path", F.col("hash").alias("subroot"))
    out = descend(levels, materialize(tops, "merkle-subroots"))
    return out.select("doc_id", "source", F.col("idx").alias("place"), F.col("hash").alias("leaf"), "other", "subroot", "path", F.lit(root["top"] if root else None).cast("string").alias("root"))


def verification(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the row still leads to the root after some texts were tampered with."""
    m = manifest(docs, tampered_leaf())
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = m.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
