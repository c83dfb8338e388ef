r"""A persistent vector index: inverted lists with residual codes, searched exactly or nearly so.

Centroids come from k-means on a bounded sample.  Each row goes to the list of
its nearest centroid, with the residual to it as one signed byte per dimension,
the length of what the code leaves out, and a hash of the vector.  Lists are
partitions on disk; one that would be large is dealt over several files.

A search ranks the lists by their centroids and reads the codes of the nearest
ones.  The distance to the decoded vector, more or less what the code leaves
out, brackets the true one, so a row whose least distance is above the k-th
greatest can't be a hit.  The rows that are left (about k a query) are joined to
their vectors and ranked by exact distances.  A near search ends there; an exact
one then reads every list that the bound and the list's radius can't exclude, so
its hits are those of a full scan.  How many lists are near enough is chosen on
the sample, for a share of the true neighbours.

``add`` writes a further generation under the same centroids.  A generation
counts once its table of lists is there, which is written last, as one file: a
crash before that leaves the index as it was, and the next ``add`` writes over
what it left.

Defined cases: rows without an id, or whose vector is null, empty, of another
length than most of the sample, or holds nulls or non-finite values, are not
indexed; rows that repeat are hits of their own; ties go by chunk_id; fewer rows
than k give fewer hits; an empty table gives an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import persisted
from .retrieval import HITS, QUERY_BLOCK, ranked

#: Rows on which centroids, steps of the codes and the number of lists to read are fitted.
SAMPLE_ROWS = 10_000
#: Most lists of an index, rows that a file of a list holds about, and rounds of k-means.
MOST_LISTS, FILE_ROWS, ROUNDS = 1024, 200_000, 8
#: Share of the true neighbours that a near search is to find, on the sample.
TARGET = 0.95
#: Rows and queries that meet at once, and found rows between two prunings.
ROWS, QUERIES, HELD = 2048, 256, 1 << 18
#: Found rows of a block of queries that may be broadcast.
BROADCAST_ROWS = 200_000
#: Squared distances are ranked with six digits; a bound must leave room for that.
SLACK = 2e-6

ROW = "chunk_id long, label int, list int, part int, code binary, left double, h long"
FOUND = "query_id long, chunk_id long, list int, h long, least double, most double"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0.0)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids; ones that lose all rows keep their place."""
    distinct = np.unique(x, axis=0)
    rng = np.random.Generator(np.random.PCG64(seed))
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & fine, F.lit(False))


class Fit:
    """What the sample says: centroids, steps of the codes, rows of the sample in each list, lists of a near search."""

    def __init__(self, x: np.ndarray, lists: int, k: int):
        self.centroids = k_means(x, lists) if len(x) else np.zeros((0, 0))
        if not len(x):
            self.steps, self.counts, self.near = np.zeros(0), np.zeros(0, dtype=np.int64), 0
            return
        d = squared(x, self.centroids)
        own = d.argmin(axis=1)
        self.steps = np.maximum(np.abs(x - self.centroids[own]).max(axis=0) / 127, 1e-12)
        self.counts = np.bincount(own, minlength=len(self.centroids))
        # the place, among the lists by distance, of the lists that the true neighbours are in
        place = np.empty_like(d, dtype=np.int64)
        np.put_along_axis(place, d.argsort(axis=1, kind="stable"), np.arange(d.shape[1])[None, :], axis=1)
        some = np.arange(0, len(x), max(1, len(x) // 256))
        neighbours = np.argpartition(squared(x[some], x), min(k, len(x) - 1), axis=1)[:, : k + 1]
        self.near = int(np.quantile(np.take_along_axis(place[some], own[neighbours], axis=1).ravel(), TARGET, method="higher")) + 1


def _assign(fit, total: int):
    """chunk_id, label, h, embedding to rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = fit.value
        parts = np.maximum(1, np.ceil(f.counts / max(1, f.counts.sum()) * total / FILE_ROWS)).astype(np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                piece = batch.slice(lo, ROWS)
                x = piece.column(3).flatten().to_numpy().astype(np.float64).reshape(piece.num_rows, -1)
                own = squared(x, f.centroids).argmin(axis=1)
                rest = x - f.centroids[own]
                code = np.clip(np.rint(rest / f.steps), -127, 127).astype(np.int8)
                left = np.sqrt(((rest - code * f.steps) ** 2).sum(axis=1))
                spread = (piece.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                part = spread.astype(np.int64) % parts[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        pa.array(own.astype(np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array([c.tobytes() for c in code], type=pa.binary()),
                        pa.array(left),
                        piece.column(2),
                        piece.column(3),
                    ],
                    names=["chunk_id", "label", "list", "part", "code", "left", "h", "embedding"],
                )

    return run


class _Found:
    """Rows that may be among the k nearest of each query, by the bounds of their distance."""

    def __init__(self, queries: int, k: int):
        self.k, self.parts, self.held = k, [], 0
        self.most = np.full((queries, k), np.inf)

    def add(self, at: np.ndarray, ids, lists, h, least: np.ndarray, most: np.ndarray) -> None:
        """at: the queries that these rows meet; least, most: (queries, rows)."""
        best = np.concatenate([self.most[at], most], axis=1)
        self.most[at] = np.partition(best, self.k - 1, axis=1)[:, : self.k]
        q, r = np.nonzero(self._in_reach(least, self.most[at].max(axis=1)[:, None]))
        self.parts.append((at[q], ids[r], lists[r], h[r], least[q, r], most[q, r]))
        self.held += len(q)
        if self.held > HELD:
            self.parts = [self.pruned()]
            self.held = len(self.parts[0][0])

    @staticmethod
    def _in_reach(least, limit):
        with np.errstate(over="ignore", invalid="ignore"):
            return np.isfinite(least) & (least * least <= limit * limit + SLACK)

    def pruned(self) -> tuple:
        if not self.parts:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int64, float, float))
        q, ids, lists, h, least, most = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        ok = self._in_reach(least, self.most.max(axis=1)[q])
        # of equal vectors the k first ids suffice
        order = np.lexsort((ids, h, q))
        new = np.r_[True, (q[order][1:] != q[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(q) else np.zeros(0, dtype=bool)
        nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        ok[order[nth >= self.k]] = False
        return tuple(c[ok] for c in (q, ids, lists, h, least, most))


def _scan(block, k: int, same_label: bool):
    """chunk_id, label, list, code, left, h to the rows that may be hits of the block's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, labels, reads, centroids, steps = block.value
        found = _Found(len(ids), k)
        for batch in batches:
            lists = batch.column(2).to_numpy()
            for one in np.unique(lists).tolist():
                meet = reads.get(one)
                if meet is None:
                    continue
                mine = np.flatnonzero(lists == one)
                for lo in range(0, len(mine), ROWS):
                    rows = batch.take(pa.array(mine[lo : lo + ROWS]))
                    code = np.frombuffer(b"".join(c.as_py() for c in rows.column(3)), dtype=np.int8).reshape(rows.num_rows, -1)
                    x = centroids[one] + code * steps
                    label, left = rows.column(1).to_numpy(zero_copy_only=False), rows.column(4).to_numpy()[None, :] + 1e-6
                    for at in (meet[b : b + QUERIES] for b in range(0, len(meet), QUERIES)):
                        d = np.sqrt(squared(queries[at], x))
                        least, most = np.maximum(d - left, 0), d + left
                        if same_label:
                            other = labels[at][:, None] != label[None, :]
                            least[other] = most[other] = np.inf
                        found.add(at, rows.column(0).to_numpy(), rows.column(2).to_numpy(), rows.column(5).to_numpy(), least, most)
        q, chunk, lists, h, least, most = found.pruned()
        for lo in range(0, len(q), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[s]]), *(pa.array(c[s]) for c in (chunk, lists, h, least, most))], names=["query_id", "chunk_id", "list", "h", "least", "most"])

    return run


class VectorIndex:
    """An index below one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        """Open what ``build`` wrote."""
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/lists").orderBy("gen", "list").collect()  # one per list and generation
        self.generations = sorted({r["gen"] for r in rows})
        first = [r for r in rows if r["gen"] == self.generations[0]]
        known = [r for r in first if r["list"] >= 0]
        self.centroids = np.array([r["centroid"] for r in known])
        self.steps, self.near, self.kind = np.array(first[0]["steps"] or []), first[0]["near"], first[0]["kind"]
        self.radius, self.rows = np.zeros(len(known)), np.zeros(len(known), dtype=np.int64)
        for r in rows:
            if r["list"] >= 0:
                self.radius[r["list"]] = max(self.radius[r["list"]], r["radius"])
                self.rows[r["list"]] += r["rows"]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, lists: int | None = None, k: int = 10) -> VectorIndex:
        """An index of ``chunks`` (chunk_id, embedding, label); its near searches are fitted to ``k`` hits."""
        rows = _rows(chunks)
        n = rows.count()
        sample = [np.array(r[0]) for r in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id", "h").limit(SAMPLE_ROWS).select("embedding").collect()]
        sizes = np.array([len(v) for v in sample], dtype=np.int64)
        size = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        x = np.array([v for v in sample if len(v) == size]) if size else np.zeros((0, 0))
        lists = lists or int(min(MOST_LISTS, max(1, round(n**0.5 / 2))))
        _write(rows, Fit(x, lists, k), size, n, path, 0)
        return cls(chunks.sparkSession, path)

    def add(self, chunks: DataFrame) -> None:
        """Further rows, as a generation of their own."""
        rows, gen = _rows(chunks.withColumn("embedding", F.col("embedding").cast(self.kind))), self.generations[-1] + 1
        if not len(self.centroids):
            raise ValueError("an index without rows has no lists to add to; build it anew")
        fit = Fit(np.zeros((0, 0)), 0, 0)
        fit.centroids, fit.steps, fit.near, fit.counts = self.centroids, self.steps, self.near, np.maximum(self.rows, 1)
        _write(rows, fit, self.centroids.shape[1], rows.count(), self.path, gen)
        self.__init__(self.spark, self.path)

    def table(self) -> DataFrame:
        schema = f"chunk_id long, label int, code binary, left double, h long, embedding {self.kind}, gen int, list int"
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*[f"{self.path}/rows/gen={g}" for g in self.generations])

    def _reads(self, d: np.ndarray, near: np.ndarray) -> dict[int, np.ndarray]:
        """For each list the queries that read it."""
        return {i: np.flatnonzero(near[:, i]) for i in range(d.shape[1]) if near[:, i].any() and self.rows[i]}

    def _near(self, d: np.ndarray) -> np.ndarray:
        """Whether a query (row) counts a list among its nearest."""
        near = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(near, d.argsort(axis=1, kind="stable")[:, : self.near], True, axis=1)
        return near

    def share_read(self, queries: DataFrame) -> float:
        """Share of the rows whose codes a near search reads, over the queries."""
        read = total = 0
        for _, q, _, _ in self._blocks(queries):
            near = self._near(squared(q, self.centroids))
            read, total = read + int((near * self.rows).sum()), total + len(q) * int(self.rows.sum())
        return read / total if total else 0.0

    def _blocks(self, queries: DataFrame) -> Iterator[tuple]:
        """ids, vectors, labels and the rows of at most about QUERY_BLOCK queries of the index's dimension."""
        if not len(self.centroids):
            return
        q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
        q = q.where(F.col("query_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == self.centroids.shape[1]))
        blocks = max(1, -(-q.count() // QUERY_BLOCK))
        for b in range(blocks):
            mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            rows = mine.orderBy("query_id").collect()
            if rows:
                yield np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([np.nan if r[2] is None else r[2] for r in rows]), mine

    def search(self, queries: DataFrame, k: int = 10, same_label: bool = False, exact: bool = True) -> DataFrame:
        """query_id, chunk_id, distance (squared, six digits), rank; queries: query_id, embedding, label.

        ``same_label`` is a predicate that holds before the cut to ``k``; a query without a label then has no hits.
        """
        out = self.spark.createDataFrame([], HITS)
        for ids, q, labels, block in self._blocks(queries):
            d = squared(q, self.centroids)
            near = self._near(d)
            found = self._candidates(ids, q, labels, self._reads(d, near), k, same_label)
            if exact:
                found = persisted(found, "index-found")
                limit = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.max("limit")).collect()}  # one per query of the block
                reach = np.array([limit.get(i, np.inf) for i in ids.tolist()])[:, None]
                # no row of a list is nearer than its centroid less the radius
                more = ~near & (np.sqrt(d) - self.radius[None, :] - 1e-6 <= np.sqrt(reach * reach + SLACK))
                reads = self._reads(d, more)
                if reads:
                    found = _in_reach(found.drop("limit").unionByName(self._candidates(ids, q, labels, reads, k, same_label).drop("limit")), k)
            out = out.unionByName(self._exact(found, block))
        return ranked(out, k)

    def _candidates(self, ids, q, labels, reads: dict, k: int, same_label: bool) -> DataFrame:
        """Rows of FOUND that may be hits, with the query's ``limit``."""
        block = self.spark.sparkContext.broadcast((ids, q, labels, reads, self.centroids, self.steps))
        rows = self.table().where(F.col("list").isin(*reads)) if reads else self.table().limit(0)
        found = rows.select("chunk_id", "label", "list", "code", "left", "h").mapInArrow(_scan(block, k, same_label), FOUND)
        return _in_reach(found, k)

    def _exact(self, found: DataFrame, block: DataFrame) -> DataFrame:
        hits = found.select("query_id", "chunk_id", "list", "h").distinct()
        vectors = self.table().select("chunk_id", "list", "h", "embedding")
        # a few rows a query; the join prunes lists by what was found
        hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
        both = vectors.join(hits, ["list", "chunk_id", "h"]).join(F.broadcast(block.select("query_id", F.col("embedding").alias("q"))), "query_id")
        squares = F.zip_with("embedding", "q", lambda a, b: (a - b) * (a - b))
        distance = F.round(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), 6)
        return both.select("query_id", "chunk_id", distance.alias("distance"))


def _in_reach(found: DataFrame, k: int) -> DataFrame:
    """Of the rows that all tasks found, those that may be among the k nearest; ``limit`` is the k-th greatest distance at most."""
    by = Window.partitionBy("query_id")
    nth = F.row_number().over(by.orderBy("most", "chunk_id"))
    limit = F.when(F.count(F.lit(1)).over(by) < k, F.lit(float("inf"))).otherwise(F.max(F.when(F.col("nth") <= k, F.col("most"))).over(by))
    out = found.withColumn("nth", nth).withColumn("limit", limit).where(F.col("least") * F.col("least") <= F.col("limit") * F.col("limit") + SLACK)
    same = Window.partitionBy("query_id", "h").orderBy("chunk_id")
    return out.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k).drop("nth")


def _rows(chunks: DataFrame) -> DataFrame:
    kind = "array<float>" if chunks.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    out = chunks.select("chunk_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    out = out.where(F.col("chunk_id").isNotNull() & usable(F.col("embedding")))
    return out.select("chunk_id", "label", F.xxhash64("embedding").alias("h"), "embedding")


def _write(rows: DataFrame, fit: Fit, size: int, n: int, path: str, gen: int) -> None:
    spark, kind = rows.sparkSession, rows.schema["embedding"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(fit)
    dealt = rows.where(F.size("embedding") == size).mapInArrow(_assign(shared, n), f"{ROW}, embedding {kind}")
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "chunk_id").drop("part")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows/gen={gen}")
    lists = len(fit.centroids)
    facts = {}
    if n and lists:
        written = spark.read.schema("chunk_id long, left double, list int, code binary").parquet(f"{path}/rows/gen={gen}")
        radius = written.select("list", "code", "left").mapInArrow(_radii(shared), "list int, radius double")
        facts = {r[0]: (r[1], r[2]) for r in radius.groupBy("list").agg(F.max("radius"), F.count(F.lit(1))).collect()}  # one per list
    steps = fit.steps.tolist()
    known = [(i, fit.centroids[i].tolist(), *(facts.get(i, (0.0, 0))), steps, fit.near, kind) for i in range(lists)] or [(-1, [], 0.0, 0, [], 0, kind)]
    table = spark.createDataFrame(known, "list int, centroid array<double>, radius double, rows long, steps array<double>, near int, kind string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/gen={gen}")


def _radii(fit):
    """An upper bound of the distance of each row to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = fit.value.steps
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(c.as_py() for c in batch.column(1)), dtype=np.int8).reshape(batch.num_rows, -1)
            far = np.sqrt(((code * steps) ** 2).sum(axis=1)) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far)], names=["list", "radius"])

    return run
