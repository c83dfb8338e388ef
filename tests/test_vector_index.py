"""The vector index against the full scan."""

import numpy as np
import pytest

from weftline.operators import retrieval
from weftline.operators import vector_index as V

SCHEMA = "chunk_id long, embedding array<float>, label int, extra string"


def vectors(n=900, d=16, seed=0):
    """Clusters, copies (a quarter of all rows is one vector) and rows that can't be indexed."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d)) * 3
    rows = [(i, (centres[i % 12] + r.normal(size=d) * 0.4).tolist(), i % 5, "x") for i in range(n)]
    rows += [(10_000 + i, rows[0][1], 0, "copy") for i in range(n // 3)]
    rows += [(7, rows[7][1], rows[7][2], "again"), (20_000, rows[3][1], None, "no label")]
    return rows


ODD = [(1, None, 1, "a"), (2, [], 1, "a"), (3, [float("nan")] * 16, 1, "a"), (4, [None] * 16, 1, "a"), (5, [1.0, 2.0], 1, "a"), (None, [0.5] * 16, 1, "a")]


def tables(spark, rows):
    chunks = spark.createDataFrame(rows, SCHEMA)
    usable = [r for r in rows if r not in ODD]
    queries = spark.createDataFrame([(r[0], r[1], r[2]) for r in usable if r[0] % 50 == 0], "query_id long, embedding array<float>, label int")
    return chunks, queries, spark.createDataFrame(usable, SCHEMA) if usable else chunks


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 4)) for r in df.collect())


@pytest.mark.parametrize("same_label", [False, True])
def test_exact_search_is_the_full_scan(spark, tmp_path, same_label):
    chunks, queries, usable = tables(spark, vectors() + ODD)
    index = V.VectorIndex.build(chunks.repartition(5), f"file://{tmp_path}/index")
    want = hits(retrieval.vector_topk(usable, queries, 7, same_label))
    assert hits(index.search(queries, 7, same_label)) == want and len(want) > 100
    # opened by its path, and with blocks of few queries and rows
    again = V.VectorIndex(spark, f"file://{tmp_path}/index")
    assert again.rows.sum() == usable.count() and (again.centroids == index.centroids).all()


def test_many_blocks_and_prunings(spark, tmp_path, monkeypatch):
    for name, value in (("QUERY_BLOCK", 9), ("QUERIES", 4), ("ROWS", 50), ("HELD", 100), ("FILE_ROWS", 40), ("BROADCAST_ROWS", 10)):
        monkeypatch.setattr(V, name, value)
    chunks, queries, usable = tables(spark, vectors(seed=3))
    index = V.VectorIndex.build(chunks, f"file://{tmp_path}/index", lists=9)
    assert hits(index.search(queries, 5)) == hits(retrieval.vector_topk(usable, queries, 5))


def test_near_search_reads_less_and_finds_nine_in_ten(spark, tmp_path):
    chunks, queries, usable = tables(spark, vectors(3000, seed=5))
    index = V.VectorIndex.build(chunks, f"file://{tmp_path}/index")
    true = {x[:1] + x[2:3] for x in hits(retrieval.vector_topk(usable, queries, 10))}
    found = {x[:1] + x[2:3] for x in hits(index.search(queries, 10, exact=False))}
    assert len(true & found) >= 0.9 * len(true) and index.share_read(queries) < 0.6


def test_generations(spark, tmp_path):
    """Rows that are added are found; what a crash left uncounted is not, and is written over."""
    rows = vectors(seed=7)
    path = f"file://{tmp_path}/index"
    chunks, queries, usable = tables(spark, rows)
    V.VectorIndex.build(chunks.where("chunk_id % 2 = 0"), path)
    index = V.VectorIndex(spark, path)
    before = hits(index.search(queries, 6))
    chunks.where("chunk_id % 2 = 1").selectExpr("chunk_id", "label", "0 AS list").write.parquet(f"{path}/rows/gen=1")  # no table of lists
    assert hits(V.VectorIndex(spark, path).search(queries, 6)) == before
    index.add(chunks.where("chunk_id % 2 = 1"))
    index.add(chunks.limit(0))
    assert hits(index.search(queries, 6)) == hits(V.VectorIndex(spark, path).search(queries, 6)) == hits(retrieval.vector_topk(usable, queries, 6))


def test_nothing_to_index_or_to_ask(spark, tmp_path):
    chunks, queries, _ = tables(spark, vectors(120))
    empty = V.VectorIndex.build(spark.createDataFrame(ODD[:4], SCHEMA), f"file://{tmp_path}/none")
    assert empty.search(queries, 5).count() == 0 and empty.share_read(queries) == 0
    with pytest.raises(ValueError, match="without rows"):
        empty.add(chunks)
    index = V.VectorIndex.build(chunks, f"file://{tmp_path}/some")
    assert index.search(queries.limit(0), 5).count() == 0
    other = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, None, 1), (None, [0.0] * 16, 1)], "query_id long, embedding array<float>, label int")
    assert index.search(other, 5).count() == 0


def test_a_task_holds_distances_of_few_queries():
    """4,000 queries against 2,048 rows: 66 MB of distances at once before, and as much for each step with them."""
    import tracemalloc

    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(4000, 4)), rng.normal(size=(2048, 4))
    best = retrieval._Best(list(range(4000)), q, 10)
    tracemalloc.start()
    best.add(np.arange(1024), x[:1024])
    best.add(np.arange(1024, 2048), x[1024:], np.zeros((4000, 1024), dtype=bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    for n in (0, 63, 64, 3999):
        assert best.i[n].tolist() == np.lexsort((np.arange(2048), np.round(((x - q[n]) ** 2).sum(axis=1), 6)))[:10].tolist()
