r"""MinHash near-dedup with odd sketches.

A document's set holds the hashes of its distinct 5-word shingles.  Documents
with equal sets collapse into one node first.  Each node has 560 MinHash values,
of which 384 make 48 bands of 8, and an odd sketch: a bitmap of 2048 bits in
which each MinHash value flips one bit, so the population count of the XOR of
two sketches grows with the number of values in which they differ and tells
high similarities apart.  Nodes that share a band are candidates; sizes and the
sketch drop those below the threshold; links are confirmed on full sets.

At similarity 0.85 a pair misses all bands with probability (1-0.85^8)^48 <
3e-7, and the sketch's limit lies five standard deviations off.

No bucket emits all of its pairs.  Round one tests each node against the least
of its hubs, the smallest nodes of its buckets, and then against those of its
hubs that are of another component.  Members that then share a component need
no further test.  Round two takes only buckets that still hold several components
and tests members of different ones, with the sketch and then the full sets
inside the join condition, so that only links leave the join; bands are long, so
texts of similarity 0.5 share a bucket in one of five cases, not in most.  Buckets and nodes that many rows share are split over tasks.

Defined cases: no text or no words: an empty set, linked with nothing; fewer
than five words: the whole sequence is the one shingle; a null doc_id is its
own component unless a copy has an id; rows that repeat a doc_id count as one
document; extra columns pass through ``deduplicate``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import NOT_SPACE, U64, Prefix, chunks, gram_hashes, mix, text_buffer, word_hashes
from .shared import KEY_ROWS, join_groups, join_split, materialize, unused

SHINGLE = 5
BANDS, ROWS = 48, 8
#: MinHash values in a sketch; the first BANDS * ROWS of them also make the bands.
MINS = 560
SKETCH_BITS = 2048
#: Standard deviations by which a pair at the threshold may look less similar than it is.
DEVIATIONS = 5
#: Members of a bucket that one task tests against all others of that bucket.
SPLIT_ROWS = 2000
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 85

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**63, MINS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, MINS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * U64(2) + U64(1)


def most_differing_bits(percent: int) -> int:
    """Largest XOR count that is taken for a pair at the threshold.

    Differing values flip two bits each; flips that meet cancel out.
    """
    p, m = 1 - percent / 100, SKETCH_BITS
    flips = 2 * MINS * p
    expected = m / 2 * (1 - (1 - 2 / m) ** flips)
    slope = (1 - 2 / m) ** flips
    sampling = 2 * (MINS * p * (1 - p)) ** 0.5 * slope
    meeting = 2 * (flips * flips / (2 * m)) ** 0.5
    return int(expected + DEVIATIONS * (sampling**2 + meeting**2) ** 0.5) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a chunk, and where each document's begin."""
    _, _, words, first = word_hashes(data, offsets, NOT_SPACE, True)
    grams = gram_hashes(words, size)
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.r_[0, np.cumsum(counts)]
    out = np.empty(at[-1], dtype=U64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        out[at[short]] = Prefix(words).hash(first[short], first[short + 1])
    for d in np.flatnonzero(n_words >= size):
        lo, hi = at[d], at[d + 1]
        out[lo:hi] = grams[first[d] : first[d] + counts[d]]
        out[lo:hi].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][counts > 0]] = True
    kept = np.r_[0, np.cumsum(fresh)]
    return out[fresh], kept[at]


SIGNATURE = "doc_id long, n long, f1 long, f2 long, sketch array<long>, bands array<long>"


def signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set fingerprints (two of 64 bits), sketches and band keys of non-empty sets."""
    f1 = np.add.reduceat(mix(sets ^ U64(0x5851F42D4C957F2D)), starts)
    f2 = np.add.reduceat(mix(sets + U64(0x14057B7EF767814F)), starts)
    n = len(starts)
    mins = np.empty((MINS, n), dtype=U64)
    scratch = np.empty(len(sets), dtype=U64)
    for j in range(MINS):
        np.multiply(sets, _A[j], out=scratch)
        np.add(scratch, _B[j], out=scratch)
        np.minimum.reduceat(scratch, starts, out=mins[j])
    bits = mix(mins + (np.arange(MINS, dtype=U64) * U64(0xD6E8FEB86659FD93))[:, None])
    bits = (bits >> U64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((bits + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)
    keys = (mins[: BANDS * ROWS].reshape(BANDS, ROWS, n) * _C[None, :, None]).sum(axis=1, dtype=U64)
    keys = mix(keys + (np.arange(1, BANDS + 1, dtype=U64) * U64(0x9FB21C651E98DF25))[:, None])
    return f1.view(np.int64), f2.view(np.int64), sketch, np.ascontiguousarray(keys.T).view(np.int64)


def _lists(values: np.ndarray, valid: np.ndarray, width: int) -> pa.Array:
    """A list column with ``width`` values where ``valid``, else null."""
    ends = np.r_[0, np.cumsum(valid * width)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~valid))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in chunks(offsets):
            sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = np.diff(at)
            some = n > 0
            f1, f2 = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
            sketch, keys = np.zeros((0, SKETCH_BITS // 64), dtype=np.int64), np.zeros((0, BANDS), dtype=np.int64)
            if some.any():
                f1[some], f2[some], sketch, keys = signatures(sets, at[:-1][some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(f1), pa.array(f2), _lists(sketch, some, SKETCH_BITS // 64), _lists(keys, some, BANDS)],
                names=["doc_id", "n", "f1", "f2", "sketch", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in chunks(offsets):
            sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))],
                names=["node", "grams"],
            )


def sketch_distance(a, b):
    """Population count of the XOR of two sketches."""
    differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    total = pairs.count()
    both = join_split(join_split(pairs, left, "a", ["b"], total), right, "b", ["a"], total)
    shared = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _as_edges(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    texts = docs.select("doc_id", "text")
    signed = materialize(texts.mapInArrow(_sign, SIGNATURE), "near-signatures")
    # equal sets have equal signatures: one node for each, whatever rows hold it
    sets_of = signed.where("n > 0").groupBy("f1", "f2", "n", "sketch", "bands").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    sets_of = materialize(sets_of, "near-groups")
    groups = sets_of.select("f1", "f2", "node", "copies")
    nodes = sets_of.where("node IS NOT NULL").select("node", "n", "sketch", "bands")
    limit = most_differing_bits(percent)
    bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("members")).where("hub < last")
    hubs = materialize(hubs, "near-hubs")
    most = hubs.agg(F.max("members")).head()[0] or 0
    hub = hubs.select("key", "hub")
    crowded = bands.join(hub, "key") if most <= KEY_ROWS else join_split(bands, hub, "key", ["node"], nodes.count() * BANDS)
    crowded = materialize(crowded, "near-buckets")

    sketches = nodes.select("node", "n", "sketch", "bands")
    sketch_a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sketch_b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = sized & (sketch_distance(F.col("sa"), F.col("sb")) <= limit)
    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that their sketches don't tell apart."""
        both = join_split(pairs, sketch_a, "a", ["b"], pairs.count()).join(sketch_b, "b")
        return materialize(both.where(near).select("a", "b"), name)

    members = materialize(crowded.select("node").distinct(), "near-members")
    wanted = texts.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    # rows that repeat a document give its set once
    sets = materialize(wanted.mapInArrow(_sets, "node long, grams array<long>").distinct(), "near-sets")

    # each node meets its least hub; its other hubs only where they are of another component then
    spokes = materialize(crowded.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-spokes")
    star = alike(materialize(spokes.groupBy("b").agg(F.min("a").alias("a")), "near-first"), "near-star")
    comps = materialize(connected_components(confirm(star, sets, percent)), "near-first-components")
    label = materialize(members.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "near-labels")
    label_a, label_b = (label.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    apart = join_split(spokes, label_a, "a", ["b"], spokes.count()).join(label_b, "b").where("ca <> cb").select("a", "b")
    star_late = alike(materialize(apart, "near-apart"), "near-star-late")
    links = materialize(confirm(star_late, sets, percent), "near-links")
    comps = materialize(connected_components(_as_edges(comps).unionByName(links)), "near-components")

    labelled = crowded.select("key", "band", "node").join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
    labelled = materialize(labelled.drop("component"), "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = join_split(labelled, mixed, "key", ["node"], labelled.count()).join(sketches, "node").join(sets, "node")
    rest = materialize(rest.select("key", "band", "node", "c", "n", "sketch", "bands", "grams"), "near-rest")

    def side(x: str) -> list:
        return [F.col(c).alias(f"{to}{x}") for c, to in (("bands", "b"), ("node", ""), ("c", "c"), ("n", "n"), ("sketch", "s"), ("grams", "g"))]

    # a pair that shares several bands comes from the first of them alone
    first = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("band") + 1
    # the full sets are compared within the join, so only links leave it
    alike_sets = F.size(F.array_intersect("ga", "gb")) * (100 + percent) >= (F.size("ga") + F.size("gb")) * percent
    pairs = join_split(rest.select("key", "band", *side("a")), rest.select("key", *side("b")), "key", ["a"], rest.count(), SPLIT_ROWS)
    late = materialize(pairs.where((F.col("ca") < F.col("cb")) & near & first & alike_sets).select("a", "b").distinct(), "near-late-links")
    if late.head() is not None:
        comps = materialize(connected_components(_as_edges(comps).unionByName(late)), "near-all")

    placed = groups.join(comps, "node", "left").select("f1", "f2", "copies", F.coalesce("component", "node").alias("component_id"))
    placed = materialize(placed, "near-placed")
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    rows = join_groups(signed.where("n > 0").select("doc_id", "n", "f1", "f2"), placed, ["f1", "f2"], "copies", signed.count()).select(*cols)
    empty = signed.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*cols)
    return rows.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns; of rows that repeat a doc_id (or, without one, a text) one stays."""
    kept = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    kept_id, same = unused(docs.columns, "kept_id", "same")
    kept = kept.select(F.col("doc_id").alias(kept_id))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    rows = rows.withColumn(same, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return rows.dropDuplicates(["doc_id", same]).select(*[F.col(f"`{c}`") for c in docs.columns])
