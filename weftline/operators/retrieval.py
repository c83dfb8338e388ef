"""Vector and lexical retrieval for batches of queries."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOPWORDS, adjacent_pairs, meaningful_terms
from .postings import match, phrase_postings, query_phrases

#: Queries that are broadcast together; more are answered block by block.
QUERY_BLOCK = 4096
#: Rows of the corpus that meet a block of queries at once.
ROWS = 2048
#: Queries of a block whose distances to these rows a task holds at once.
TOGETHER = 64

HITS = "query_id long, chunk_id long, distance double"


#: Labels whose nearest rows a task holds at once; beyond that it sends what it has and begins anew.
LABELS = 256


class _Best:
    """The k nearest rows so far of each query."""

    def __init__(self, ids: list, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.d = np.full((len(ids), 0), np.inf)
        self.i = np.zeros((len(ids), 0), dtype=np.int64)

    def add(self, chunk: np.ndarray, x: np.ndarray, other: np.ndarray | None = None) -> None:
        """other: pairs of query and row that don't count."""
        kept = []
        for lo in range(0, len(self.ids), TOGETHER):
            s = slice(lo, lo + TOGETHER)
            queries = self.queries[s]
            # exact differences, query by query: no cancellation
            d = np.empty((len(queries), len(chunk)))
            for q in range(len(queries)):
                d[q] = ((x - queries[q]) ** 2).sum(axis=1)
            d = np.round(d, 6)
            if other is not None:
                d[other[s]] = np.inf
            d = np.concatenate([self.d[s], d], axis=1)
            i = np.concatenate([self.i[s], np.tile(chunk, (len(queries), 1))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, : self.k]
            kept.append((np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)))
        if kept:
            self.d, self.i = (np.concatenate(c) for c in zip(*kept, strict=True))

    def rows(self, label=None) -> Iterator[pa.RecordBatch]:
        found = np.isfinite(self.d)
        if found.any():
            columns = [pa.array(np.repeat(self.ids, found.sum(axis=1))), pa.array(self.i[found]), pa.array(self.d[found])]
            names = ["query_id", "chunk_id", "distance"]
            if label is not None:
                columns, names = [*columns, pa.array(np.full(len(columns[0]), label, dtype=np.int32))], [*names, "label"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """chunk_id, vectors and labels, ROWS at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(zero_copy_only=False), x, part.column(2).to_numpy(zero_copy_only=False)


def _nearest(block, k: int, same_label: bool):
    """Per task, the k nearest rows of each query: what leaves a task is bounded by queries, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, labels = block.value
        best = _Best(ids, queries, k)
        for chunk, x, label in _parts(batches):
            best.add(chunk, x, np.asarray(labels)[:, None] != label[None, :] if same_label else None)
        yield from best.rows()

    return run


def _nearest_by_label(block, k: int):
    """Per task and label, the k nearest rows of each query, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, _ = block.value
        best: dict[int, _Best] = {}
        for chunk, x, label in _parts(batches):
            for one in np.unique(label).tolist():
                at = label == one
                best.setdefault(one, _Best(ids, queries, k)).add(chunk[at], x[at])
            if len(best) > LABELS:
                for one, b in best.items():
                    yield from b.rows(one)
                best = {}
        for one, b in best.items():
            yield from b.rows(one)

    return run


def _blocks(queries: DataFrame) -> Iterator:
    """Broadcasts of (ids, vectors, labels) of at most about QUERY_BLOCK queries."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = mine.select("query_id", "embedding", "label").orderBy("query_id").collect()
        if rows:
            value = ([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), [r[2] for r in rows])
            yield queries.sparkSession.sparkContext.broadcast(value)


def vector_topk_by_label(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance, label: of each label the k nearest, whatever labels there are; rows without a label go."""
    rows = chunks.where(F.col("label").isNotNull()).select("chunk_id", "embedding", "label")
    out = chunks.sparkSession.createDataFrame([], f"{HITS}, label int")
    for block in _blocks(queries):
        out = out.unionByName(rows.mapInArrow(_nearest_by_label(block, k), f"{HITS}, label int"))
    by = Window.partitionBy("query_id", "label").orderBy("distance", "chunk_id")
    return out.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r")


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = 10, same_label: bool = False) -> DataFrame:
    """query_id, chunk_id, distance (squared L2, 6 digits), rank of the k nearest; ties by chunk_id.

    chunks: chunk_id, embedding, label; queries: query_id, embedding, label.
    ``same_label`` is the predicate that holds before the cut to k.  Queries
    come in blocks; each task keeps k rows a query, so the exchange carries
    queries * k rows a task whatever the size of the corpus.
    """
    out = chunks.sparkSession.createDataFrame([], HITS)
    for block in _blocks(queries):
        out = out.unionByName(chunks.select("chunk_id", "embedding", "label").mapInArrow(_nearest(block, k, same_label), HITS))
    return ranked(out, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """Hits of a query's variants as one list: the least distance of each chunk, the k best."""
    merged = hits.groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance"))
    return ranked(merged, k)


def multi_source_topk(hits: DataFrame, k: int, source: str = "label") -> DataFrame:
    """At most max(3, k // 4) hits of each source, then the k best; no dedup across sources."""
    per = max(3, k // 4)
    by = Window.partitionBy("query_id", source).orderBy("distance", "chunk_id")
    return ranked(hits.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per).drop("r"), k)


def within_distance(hits: DataFrame, most: float | None, phrase: Column | None = None) -> DataFrame:
    """After the cut to k: hits near enough, or with an exact phrase; None keeps all."""
    if most is None:
        return hits
    near = F.coalesce(F.col("distance") <= most, F.lit(False))
    return hits.where(near | F.coalesce(phrase, F.lit(False)) if phrase is not None else near)


def query_block(queries: DataFrame, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """One-row frames, each with an array of prepared queries (id, terms, pairs)."""
    n = queries.count()
    blocks = max(1, -(-n // size))
    prepared = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"),
        F.struct(F.col("query_id").alias("id"), meaningful_terms(F.col("text")).alias("terms"), adjacent_pairs(meaningful_terms(F.col("text"))).alias("pairs")).alias("q"),
    )
    grouped = prepared.groupBy("b").agg(F.sort_array(F.collect_list("q")).alias("queries"))
    return [grouped.where(F.col("b") == b).select("queries") for b in range(blocks)]


_TOKEN = re.compile("[a-z0-9]+")
SCORES = "query_id long, doc_id long, score double"


def _six_digits(x: float) -> float:
    """Halves go up, as in SQL."""
    return math.floor(x * 1e6 + 0.5) / 1e6


def _best_by_terms(block, k: int):
    """Per task, the k best documents of each query: an inverted index of the block's terms counts what is shared.

    The phrase bonus is looked for only where it could lift a document into the k best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        index: dict[str, list[int]] = {}
        for q, (_, terms, _) in enumerate(queries):
            for t in set(terms):
                index.setdefault(t, []).append(q)
        sizes = [len(set(terms)) for _, terms, _ in queries]
        best: list[list[tuple[float, int]]] = [[] for _ in queries]  # heaps of (score, -doc_id): the worst first
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = [t for t in _TOKEN.findall((value.as_py() or "").lower()) if len(t) > 2 and t not in QUERY_STOPWORDS]
                known = set(terms)
                shared: dict[int, int] = {}
                for t in known:
                    for q in index.get(t, ()):
                        shared[q] = shared.get(q, 0) + 1
                text = None
                for q, n in shared.items():
                    plain = 0.7 * (n / sizes[q]) + 0.25 * (n / len(known))
                    heap = best[q]
                    if len(heap) == k and (_six_digits(min(1.0, plain + 0.05)), -doc_id) <= heap[0]:
                        continue
                    text = " ".join(terms) if text is None else text
                    bonus = 0.05 if any(p in text for p in queries[q][2]) else 0.0
                    item = (_six_digits(min(1.0, plain + bonus)), -doc_id)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        rows = [(queries[q][0], -d, s) for q, heap in enumerate(best) for s, d in heap]
        if rows:
            ids, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(docs, type=pa.int64()), pa.array(scores)], names=["query_id", "doc_id", "score"])

    return run


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query by the heuristic score, ties by doc_id.

    Queries come in blocks of bounded size; each task keeps k rows a query.
    """
    spark = docs.sparkSession
    out = None
    for block in query_block(queries):
        rows = [(q["id"], list(q["terms"]), list(q["pairs"])) for r in block.collect() for q in r["queries"]]  # at most about QUERY_BLOCK
        found = docs.select("doc_id", "text").mapInArrow(_best_by_terms(spark.sparkContext.broadcast(rows), k), SCORES)
        out = found if out is None else out.unionByName(found)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def phrase_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id where two neighbouring terms of the query stand in the document."""
    return match(phrase_postings(docs), query_phrases(queries))


def recall_at_k(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Share of queries whose k best hits hold all expected terms in their joined text, 4 digits.

    hits: query_id, rank, text; expected: query_id, terms.
    """
    joined = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("all"))
    scored = expected.join(joined, "query_id", "left").withColumn(
        "hit", F.forall("terms", lambda t: F.coalesce(F.contains(F.col("all"), F.lower(t)), F.lit(False)))
    )
    return scored.agg(F.round(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)), 4).alias("recall"), F.count(F.lit(1)).alias("queries"))


def benchmark_sample(chunks: DataFrame, size: int = 250) -> DataFrame:
    """The first ``size`` chunks by id, on which encoders are compared; the limit is the feature."""
    return chunks.orderBy("chunk_id").limit(size)
