r"""Near-dedup of embeddings by hashing to the E8 lattice.

A table projects unit vectors to BLOCKS times eight random directions, scales
them, and rounds each block to the nearest point of the E8 lattice; the points,
the label and the length of the vector are the vector's home cell.  A vector
also probes the PROBES neighbouring cells (points one minimal vector away) that
lie nearest to it.  Two vectors meet in a cell if it is the home of both, or the
home of one and a probe of the other.

Equal vectors of a label become one node first.  Cells in which nothing can meet
are dropped on their keys alone; in the others, nodes come first with a sketch of
BITS signs of random projections each, and only those stay of which another's
sketch differs in few enough bits (five standard deviations above what the
threshold makes likely).  So vectors are shuffled only for nodes that have a
near one.  In a cell the cosines come from products of blocks of vectors in double precision, and what
leaves it is one row per node: the number of its links and one link towards the
rest of its component; pairs are never emitted.  A pair that meets in several
cells counts in the one of the least key.  Cells of over SPLIT nodes are split
into blocks, and each pair of blocks is a task's work of its own, so no task
holds more than two blocks, and all pairs are compared.

At cosine 0.93 in 64 dimensions two vectors miss all TABLES tables in less than
one case in 500 (measured; less often, the closer they are); nothing below the
threshold is ever linked.

Defined cases: a null label, a null or zero vector, and one with null, NaN or
infinite components link with nothing; vectors of unequal length don't link;
every row is a vector, so rows that repeat an id and a vector are linked with
each other; a null vec_id takes part, and is kept only if no vector that it
reaches has an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, mix, text_buffer
from .shared import join_groups, materialize

COSINE = 0.93
TABLES, BLOCKS, PROBES = 16, 2, 2
#: Lattice units of a projected unit vector.
SCALE = 0.5
#: Nodes of a cell that are compared in one piece; larger cells are split into blocks of about this many.
SPLIT = 2048
#: Rows of a product of vectors, and pairs that are looked at, at once.
ROWS, PAIRS = 512, 1 << 16
#: Cells of at most this many nodes are compared many at a time.
SMALL = 24

#: Signs in a sketch, and standard deviations by which a pair at the threshold may differ more than it is likely to.
BITS, DEVIATIONS = 128, 5

SIGNED = "node long, copies long, vec binary, homes array<long>, probes array<long>, s1 long, s2 long"
MET = "key long, i int, j int, side int, node long, home int"
FOUND = "node long, links long, towards long"


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


MINIMAL = minimal_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the worst rounded coordinate goes the other way."""
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    k = np.abs(d[odd]).argmax(axis=1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1, -1)
    return f


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of the integer points of even sum, and of these moved by halves."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _coordinate_weights(table: int) -> np.ndarray:
    return mix(np.arange(1, 8 * BLOCKS + 1, dtype=U64) * U64(0x9FB21C651E98DF25) + U64((table + 1) * 0xD6E8FEB86659FD93 % 2**64)) | U64(1)


def _cell(points: np.ndarray, table: int, salt: np.ndarray) -> np.ndarray:
    """Keys of the cells of (n, 8 * BLOCKS) lattice coordinates."""
    doubled = np.rint(points * 2).astype(np.int64).view(U64)
    # each coordinate is mixed with its place before the sum
    w = _coordinate_weights(table)
    return mix(mix(doubled + w[None, :]).sum(axis=1, dtype=U64) ^ salt)


def cells(unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home (n, TABLES) and probed (n, TABLES * PROBES) cells of unit vectors of one length."""
    n, d = unit.shape
    homes, probes = np.empty((n, TABLES), dtype=U64), np.empty((n, TABLES, PROBES), dtype=U64)
    rng = np.random.Generator(np.random.PCG64([7, d]))
    each = np.arange(n)
    for t in range(TABLES):
        y = unit @ (rng.normal(size=(d, 8 * BLOCKS)) * SCALE)
        flat = y.reshape(n * BLOCKS, 8)
        c = nearest_point(flat)
        homes[:, t] = _cell(c.reshape(n, 8 * BLOCKS), t, salt)
        # the farther the vector lies towards a neighbour, the nearer is that neighbour
        towards = ((flat - c) @ MINIMAL.T).reshape(n, BLOCKS * len(MINIMAL))
        best = np.argpartition(-towards, PROBES - 1, axis=1)[:, :PROBES]
        for p in range(PROBES):
            moved = c.reshape(n, BLOCKS, 8).copy()
            moved[each, best[:, p] // len(MINIMAL)] += MINIMAL[best[:, p] % len(MINIMAL)]
            probes[:, t, p] = _cell(moved.reshape(n, 8 * BLOCKS), t, salt)
    return homes, probes.reshape(n, TABLES * PROBES)


def sketches(unit: np.ndarray) -> np.ndarray:
    """Signs of BITS random projections, as two numbers."""
    d = unit.shape[1]
    directions = np.random.Generator(np.random.PCG64([8, d])).normal(size=(d, BITS))
    return np.packbits(unit @ directions > 0, axis=1).view(np.int64)  # the columns that Spark has


def most_differing_signs(cosine: float) -> int:
    """Bits in which a pair at ``cosine`` may differ: each does with the share of the half turn that its angle is."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(BITS * p + DEVIATIONS * (BITS * p * (1 - p)) ** 0.5) + 1


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, copies, label, embedding of usable vectors to their unit vectors and cells."""
    for batch in batches:
        labels = np.asarray(batch.column(2).cast(pa.int64()))
        lists = batch.column(3)
        size = np.diff(np.asarray(lists.offsets))
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.r_[0, np.cumsum(size)[:-1]]
        for d in np.unique(size).tolist():
            of_length = np.flatnonzero(size == d)
            for lo in range(0, len(of_length), ROWS):
                at = of_length[lo : lo + ROWS]
                unit = unit_vectors(values[first[at][:, None] + np.arange(d)])
                homes, probes = cells(unit, mix(labels[at].view(U64) * U64(0x9E3779B97F4A7C15) + U64(d)))
                take = pa.array(at)
                signs = sketches(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array([v.tobytes() for v in unit], type=pa.binary()),
                        *(pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * k.shape[1]).astype(np.int32)), pa.array(k.view(np.int64).ravel())) for k in (homes, probes)),
                        pa.array(signs[:, 0]),
                        pa.array(signs[:, 1]),
                    ],
                    names=["node", "copies", "vec", "homes", "probes", "s1", "s2"],
                )


class _Cells:
    """The rows of some cells, as arrays; the rows of a cell follow each other."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.key, self.i, self.j, self.side, self.node = (self.table[c].to_numpy() for c in ("key", "i", "j", "side", "node"))
        self.home = self.table["home"].to_numpy().astype(bool)
        self.cell = np.r_[_starts(self.key, self.i, self.j), len(self.key)]


class _Sketched(_Cells):
    """Rows with sketches, which are close if they differ in few bits."""

    def __init__(self, batches: list[pa.RecordBatch], cosine: float):
        super().__init__(batches)
        self.most = most_differing_signs(cosine)
        self.signs = [self.table[c].to_numpy().view(U64) for c in ("s1", "s2")]

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a (..., m) and b (..., n), whether each pair is close."""
        return sum(np.bitwise_count(s[a][..., :, None] ^ s[b][..., None, :]).astype(np.int16) for s in self.signs) <= self.most


class _Vectors(_Cells):
    """Rows with vectors, which are close if their cosine says so."""

    def __init__(self, batches: list[pa.RecordBatch], cosine: float):
        super().__init__(batches)
        self.cosine, n = cosine, len(self.key)
        self.copies = self.table["copies"].to_numpy()
        lists = lambda c: self.table[c].combine_chunks().flatten().to_numpy()
        self.homes, self.probes = lists("homes").reshape(n, TABLES), lists("probes").reshape(n, TABLES, PROBES)
        data, offsets = text_buffer(self.table["vec"].combine_chunks())
        self.values, self.start = data.view(np.float64), offsets // 8

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """The vectors of some rows, all of one length: the key of a cell covers it."""
        d = self.start[at.flat[0] + 1] - self.start[at.flat[0]]
        return self.values[self.start[at][..., None] + np.arange(d)]

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.vectors(a) @ self.vectors(b).swapaxes(-1, -2) >= self.cosine


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before them; 0 is such a place."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def counted_here(c: _Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs of rows (a, b) count in the cell that they are in: of all cells where they meet, that of the least key."""
    most = np.iinfo(np.int64).max
    ha, hb = c.homes[a], c.homes[b]
    least = np.where(ha == hb, ha, most)
    for p in range(PROBES):
        least = np.minimum(least, np.where(c.probes[b, :, p] == ha, ha, most))
        least = np.minimum(least, np.where(c.probes[a, :, p] == hb, hb, most))
    return least.min(axis=1) == c.key[a]


def _close_in_large(c: _Sketched | _Vectors, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of rows of one cell."""
    for r in range(lo, hi, ROWS):
        a = np.arange(r, min(r + ROWS, hi))
        for s in range(r, hi, ROWS):
            b = np.arange(s, min(s + ROWS, hi))
            close = c.close(a, b) & (c.home[a, None] | c.home[None, b])
            if r == s:
                close &= np.triu(np.ones(close.shape, dtype=bool), 1)
            if c.i[lo] != c.j[lo]:  # two blocks of a split cell; pairs within a block have a cell of their own
                close &= c.side[a, None] != c.side[None, b]
            x, y = np.nonzero(close)
            for k in range(0, len(x), PAIRS):
                yield a[x[k : k + PAIRS]], b[y[k : k + PAIRS]]


def _close_in_small(c: _Sketched | _Vectors, starts: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many cells of ``m`` rows and of vectors of one length."""
    p, q = np.triu_indices(m, 1)
    step = max(1, PAIRS // len(p))
    for k in range(0, len(starts), step):
        at = starts[k : k + step]
        rows = at[:, None] + np.arange(m)
        home, side, split = c.home[rows], c.side[rows], (c.i[at] != c.j[at])[:, None]
        close = c.close(rows, rows)[:, p, q] & (home[:, p] | home[:, q]) & (~split | (side[:, p] != side[:, q]))
        cell, pair = np.nonzero(close)
        yield at[cell] + p[pair], at[cell] + q[pair]


def close_pairs(c: _Sketched | _Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of rows of all cells, some at a time."""
    size = np.diff(c.cell)
    small = (size > 1) & (size <= SMALL)
    length = np.diff(c.start)[c.cell[:-1]] if isinstance(c, _Vectors) else np.zeros(len(size), dtype=np.int64)
    for m, d in sorted(set(zip(size[small].tolist(), length[small].tolist(), strict=True))):
        yield from _close_in_small(c, c.cell[:-1][(size == m) & (length == d)], m)
    for k in np.flatnonzero(size > SMALL).tolist():
        yield from _close_in_large(c, int(c.cell[k]), int(c.cell[k + 1]))


class _Tally:
    """Links and components of the rows of some cells."""

    def __init__(self, c: _Vectors):
        self.c, self.links = c, np.zeros(len(c.key), dtype=np.int64)
        self.low = np.arange(len(c.key))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        c, low = self.c, self.low
        here = counted_here(c, a, b)
        np.add.at(self.links, a[here], c.copies[b[here]])
        np.add.at(self.links, b[here], c.copies[a[here]])
        # each row points to the least row of its component; only such rows are moved, so nothing that is joined comes apart
        while (low[a] != low[b]).any():
            la, lb = low[a], low[b]
            np.minimum.at(low, np.maximum(la, lb), np.minimum(la, lb))
            while (low[low] != low).any():
                low[:] = low[low]

    def rows(self) -> pa.RecordBatch:
        """node, its links, and a node that it reaches, of all rows that have a link."""
        c = self.c
        some = np.flatnonzero((self.links > 0) | (self.low != np.arange(len(self.low))))
        return pa.RecordBatch.from_arrays([pa.array(c.node[some]), pa.array(self.links[some]), pa.array(c.node[self.low[some]])], names=["node", "links", "towards"])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Lots of rows in which no cell is cut; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(k).to_numpy() for k in range(3))
        if held and last != (key[0], i[0], j[0]):
            yield held
            held = []
        if cut := int(_starts(key, i, j)[-1]):
            yield [*held, batch.slice(0, cut)]
            held = []
        held.append(batch.slice(cut))
        last = (key[-1], i[-1], j[-1])
    if held:
        yield held


def _survivors(cosine: float):
    """Rows with sketches to those that have a close one in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _whole_cells(batches):
            c = _Sketched(lot, cosine)
            keep = np.zeros(len(c.key), dtype=bool)
            for a, b in close_pairs(c):
                keep[a] = keep[b] = True
            yield from c.table.filter(pa.array(keep)).select(["key", "i", "j", "side", "node", "home"]).to_batches()

    return run


def _compare(cosine: float):
    """Rows with vectors to the links of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _whole_cells(batches):
            c = _Vectors(lot, cosine)
            tally = _Tally(c)
            for a, b in close_pairs(c):
                tally.add(a, b)
            yield tally.rows()

    return run


def usable(embedding, label):
    """Whether a vector can be compared at all."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), embedding.alias("embedding"))
    rows = rows.withColumn("usable", usable(F.col("embedding"), F.col("label")))
    # equal vectors of a label are one node; 128 bits stand for them where rows look up their node
    prints = [F.xxhash64(F.lit(seed), "label", "embedding").alias(f"f{seed}") for seed in (1, 2)]
    nodes = rows.where("usable").select("vec_id", "label", "embedding", *prints).groupBy("f1", "f2", "label", "embedding")
    nodes = nodes.agg(F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    signed = materialize(nodes.select("node", "copies", "label", "embedding").mapInArrow(_sign, SIGNED), "lattice-signed")

    meet = F.concat(
        F.transform("homes", lambda x: F.struct(x.alias("key"), F.lit(1).alias("home"))),
        F.transform("probes", lambda x: F.struct(x.alias("key"), F.lit(0).alias("home"))),
    )
    keys = signed.select("node", "s1", "s2", F.explode(meet).alias("x")).select("node", "s1", "s2", "x.key", "x.home")
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("home").alias("at_home")).where("n > 1 AND at_home > 0")
    crowded = materialize(crowded.select("key", "n"), "lattice-crowded")
    total = signed.count() * TABLES * (1 + PROBES)
    met = join_groups(keys, crowded, ["key"], "n", total).where("n IS NOT NULL")
    parts, own = F.ceil(F.col("n") / SPLIT).cast("int"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "home", "s1", "s2")
    by_cell = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = materialize(by_cell(met).mapInArrow(_survivors(cosine), MET), "lattice-met")
    near = met.join(signed.drop("s1", "s2"), "node").select(*met.columns, "copies", "vec", "homes", "probes")
    found = materialize(by_cell(near).mapInArrow(_compare(cosine), FOUND), "lattice-found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("towards").alias("b")))
    placed = nodes.select("node", "f1", "f2", "copies", "lowest").join(links, "node", "left").join(comps, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node")).withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    placed = materialize(placed.drop("links"), "lattice-placed")
    least = placed.groupBy("component").agg(F.min("lowest").alias("component_id"), F.count(F.lit(1)).alias("members"))
    placed = join_groups(placed, least, ["component"], "members", total)
    placed = materialize(placed.select("f1", "f2", "copies", "n_links", "component_id"), "lattice-components")

    seen = rows.where("usable").select("vec_id", *prints)
    out = join_groups(seen, placed, ["f1", "f2"], "copies", total).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
