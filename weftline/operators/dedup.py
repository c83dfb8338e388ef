"""Exact, near and chunk dedup as they stand in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shingles
from ..functions.text import content_hash, normalize
from ..storage import persisted

#: Texts that the order of shingles is taken from, and shingles that it tells apart; neither changes what is found.
SAMPLE, COMMON = 20_000, 200_000


def first_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key: one aggregation with partial results, no window over hot keys."""
    columns = [c for c in df.columns]
    ranked = df.withColumn("__k", key).withColumn("__o", F.struct(*order))
    best = ranked.groupBy("__k").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col("__o")).alias("r"))
    return best.select(*[F.col("r").getField(c).alias(c) for c in columns])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, hash and the first document with the same normalised text."""
    return _first_of_copies(docs.select("doc_id", content_hash(F.col("text")).alias("hash")))


def _first_of_copies(hashed: DataFrame) -> DataFrame:
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, "hash").select("doc_id", "hash", "first_id", "copies", (F.col("doc_id") == F.col("first_id")).alias("kept"))


def distinct_in_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """Stable distinct: the first position of each key."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def _common_shingles(docs: DataFrame, size: int) -> tuple:
    """Shingles that several of about SAMPLE texts hold, and in how many: a sample by hash of the id, at most COMMON shingles."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(normalize(F.col("text")).alias("t"))
    some = some.groupBy(F.sha2("t", 256)).agg(F.first("t").alias("t")).select("t")
    counts = some.mapInArrow(shingles.each(size), "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    met = counts.orderBy(F.desc("n"), "g").limit(COMMON).toArrow().sort_by("g")
    return met["g"].to_numpy(), met["n"].to_numpy()


def _prefixes(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """id, hash, n, prefix of every row: the digest of its normalised text, how many shingles it has, and the rarest of them."""
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, size))
    t = normalize(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2(t, 256).alias("hash"), t.alias("t"))
    return persisted(rows.mapInArrow(shingles.prefixes(size, threshold, common), f"id {docs.schema['doc_id'].dataType.simpleString()}, hash string, n int, prefix array<long>"), "shingle-prefixes")


def similar_pairs(docs: DataFrame, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """a, b, similarity of all pairs of distinct normalised texts with Jaccard >= threshold.

    a < b are the smallest doc_ids of their texts.  A prefix-filtered join:
    shingles are ordered by rarity; two sets that reach the threshold share one
    of the n - ceil(t * n) + 1 rarest of each.  Any order finds all pairs; this
    one comes from a sample of bounded size, so that the sets, most of what the
    join would move, stay in the tasks that make them.  Only texts of candidates
    are read again, for their whole sets.
    """
    return _pairs(docs, _prefixes(docs, threshold, size), threshold, size)


def _pairs(docs: DataFrame, found: DataFrame, threshold: float, size: int) -> DataFrame:
    copies = found.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = found.select("id", "hash").join(copies, "hash").where("id > first").select("id").distinct()
    prefix = found.where("n > 0").join(copies, "id", "left_anti").select("id", "n", F.posexplode("prefix").alias("at", "g"))

    def side(x: str) -> DataFrame:
        return prefix.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), "g")

    # after the first shingle that both have, neither set can share more than what it has left
    left_over = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    reach = (left_over * (1 + threshold) >= (F.col("na") + F.col("nb")) * threshold - 1e-6) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6)
    pairs = persisted(side("a").join(side("b"), "g").where((F.col("a") < F.col("b")) & reach).select("a", "b").distinct(), "shingle-candidates")
    members = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(members, "doc_id", "left_semi").select("doc_id", normalize(F.col("text")).alias("t"))
    sets = persisted(texts.mapInArrow(shingles.sets(size), f"id {docs.schema['doc_id'].dataType.simpleString()}, s array<long>"), "shingle-sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared))
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def greedy_keep(docs: DataFrame, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """doc_id, kept: in order of doc_id a document goes if it is like an earlier one that stays.

    Documents that go never count against later ones.  Rounds over the pairs:
    a document stays once no earlier neighbour is open or stays, and goes once
    an earlier neighbour stays.  Each round settles at least the first open
    document of every chain.
    """
    found = _prefixes(docs, threshold, size)
    exact = _first_of_copies(found.select(F.col("id").alias("doc_id"), "hash")).select("doc_id", F.col("kept").alias("first"))
    pairs = persisted(_pairs(docs, found, threshold, size).select("a", "b"), "pairs")
    goes = pairs.sparkSession.createDataFrame([], "id long")
    stays = pairs.sparkSession.createDataFrame([], "id long")
    left = pairs
    while left.head() is not None:
        # a that is nobody's open later neighbour stays
        later = left.select(F.col("b").alias("id")).distinct()
        now = left.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        gone = left.join(now.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        now, gone = persisted(now, "stays"), persisted(gone, "goes")
        stays, goes = stays.union(now), goes.union(gone)
        # pairs with a settled side are done
        done = now.union(gone)
        left = left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        left = persisted(left, "open")
    marked = exact.join(goes.distinct().select(F.col("id").alias("doc_id"), F.lit(True).alias("goes")), "doc_id", "left")
    return marked.select("doc_id", (F.col("first") & F.col("goes").isNull()).alias("kept"))


def chunk_dedup(chunks: DataFrame) -> DataFrame:
    """First chunk of each normalised raw content, by document, then position; ids stay as they are."""
    text = F.when(F.coalesce(F.col("raw_content"), F.lit("")) != "", F.col("raw_content")).otherwise(F.col("content"))
    return first_per_key(chunks, content_hash(text), [F.col("source_file"), F.col("chunk_id")])
