"""Queries of the retrieval path: vectors, lexical ranking, contexts, confidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import context as C
from ..operators import retrieval as R
from ..operators.postings import PhraseIndex
from ..operators.vector_index import VectorIndex
from ..storage import fresh_path, table
from .text_queries import TERMS


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    # the stated query set: every row whose id is divisible by 100
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return chunks, queries


def _top(spark, sf, k=10, same_label=False):
    chunks, queries = _vectors(spark, sf)
    return R.vector_topk(chunks, queries, k, same_label)


def vector_topk(spark, sf):
    return _top(spark, sf).select("query_id", "chunk_id", "distance", "rank")


def vector_topk_filtered(spark, sf):
    return _top(spark, sf, 10, True).select("query_id", "chunk_id", "distance", "rank")


def vector_within_distance(spark, sf):
    return R.within_distance(_top(spark, sf), 1.5).select("query_id", "chunk_id", "distance", "rank")


def vector_multi_source_topk(spark, sf):
    chunks, queries = _vectors(spark, sf)
    hits = R.vector_topk_by_label(chunks, queries, 3)
    return R.multi_source_topk(hits, 10).select("query_id", "label", "chunk_id", "distance", "rank")


def vector_index_topk(spark, sf):
    """The 10 nearest by an index that is built, written and opened again; the exact search."""
    chunks, queries = _vectors(spark, sf)
    path = fresh_path(spark, "vector-index")
    VectorIndex.build(chunks, path)
    return VectorIndex(spark, path).search(queries).select("query_id", "chunk_id", "distance", "rank")


def vector_index_filtered(spark, sf):
    """The same within the query's label, over an index that grew by a second generation."""
    chunks, queries = _vectors(spark, sf)
    index = VectorIndex.build(chunks.where("chunk_id % 3 <> 0"), fresh_path(spark, "vector-index"))
    index.add(chunks.where("chunk_id % 3 = 0"))
    return index.search(queries, same_label=True).select("query_id", "chunk_id", "distance", "rank")


def vector_index_recall(spark, sf):
    """Whether a near search finds nine in ten of the true 10 nearest, and only exact distances."""
    chunks, queries = _vectors(spark, sf)
    near = VectorIndex.build(chunks, fresh_path(spark, "vector-index")).search(queries, exact=False)
    near = near.select("query_id", "chunk_id", F.col("distance").alias("found"))
    both = R.vector_topk(chunks, queries, 10).join(near, ["query_id", "chunk_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.coalesce(F.bool_and(F.col("found") == F.col("distance")), F.lit(True)).alias("exact"),
    )


def variant_merge_min_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    chunks, queries = _vectors(spark, sf)
    more = e.where(F.col("vec_id") % 100 == 1).select((F.col("vec_id") - 1).alias("query_id"), "embedding", "label")
    hits = R.vector_topk(chunks, queries, 10).unionByName(R.vector_topk(chunks, more, 10)).drop("rank")
    return R.merge_variants(hits, 10).select("query_id", "chunk_id", "distance", "rank")


def retrieval_confidence(spark, sf):
    top = _top(spark, sf)
    c = top.groupBy("query_id").agg(F.round(S.retrieval_confidence(F.col("distance")), 6).alias("confidence"), F.count(F.lit(1)).alias("hits"))
    return c.select("query_id", "confidence", "hits", S.confidence_label(F.col("confidence")).alias("label"))


def recall_at_k(spark, sf):
    chunks, queries = _vectors(spark, sf)
    hits = R.vector_topk(chunks, queries, 5).join(chunks.select("chunk_id", F.concat(F.lit("Label "), F.col("label").cast("string")).alias("text")), "chunk_id")
    expected = queries.select("query_id", F.array(F.concat(F.lit("label "), F.col("label").cast("string"))).alias("terms"))
    return R.recall_at_k(hits, expected, 5)


def benchmark_sample_recall(spark, sf):
    """Recall at 5 over the sample of 250 that encoders are compared on."""
    chunks, queries = _vectors(spark, sf)
    sample = R.benchmark_sample(chunks)
    hits = R.vector_topk(sample, queries, 5).join(F.broadcast(sample.select("chunk_id", F.concat(F.lit("Label "), F.col("label").cast("string")).alias("text"))), "chunk_id")
    expected = queries.select("query_id", F.array(F.concat(F.lit("label "), F.col("label").cast("string"))).alias("terms"))
    return R.recall_at_k(hits, expected, 5)


def _benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, sf, k=5):
    return R.lexical_topk(table(spark, sf, "documents"), _benchmark(spark, sf), k)


def heuristic_rerank_topk(spark, sf):
    return _lexical(spark, sf).select("query_id", "doc_id", "score", "rank")


def rerank_margin(spark, sf):
    top = _lexical(spark, sf)
    return top.groupBy("query_id").agg(F.round(S.margin_confidence(F.collect_list("score")), 6).alias("confidence"))


def phrase_hits(spark, sf):
    return R.phrase_hits(table(spark, sf, "documents"), _benchmark(spark, sf)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("sum_ids")
    )


def phrase_index_hits(spark, sf):
    """The same from postings that are written and opened again."""
    path = fresh_path(spark, "phrases")
    PhraseIndex.build(table(spark, sf, "documents"), path)
    return PhraseIndex(spark, path).search(_benchmark(spark, sf)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("sum_ids")
    )


def _contexts(spark, sf, budget=1200):
    top = _lexical(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = top.join(d, "doc_id").select(
        "query_id", "rank", F.col("doc_id").alias("chunk_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("https://example.com/"), F.col("source")).alias("url"), F.lit("").alias("section"), "text", "score",
    )
    return C.build_contexts(hits, budget)


def context_budget(spark, sf):
    return _contexts(spark, sf).select("query_id", F.md5("context").alias("context_md5"), "n_sources", "used_tokens", F.array_join("sources", ",").alias("sources"))


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("context", F.array_join(F.collect_list("text").over(before), " "))
    return c.where(F.col("role") == "assistant").withColumn("g", S.grounding(F.col("text"), F.col("context")))


def conversation_grounding(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round("g", 6).alias("grounding"))


def answer_quality(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(S.answer_quality(F.col("text"), F.col("context"), F.col("g")), 6).alias("quality"))


def final_confidence(spark, sf):
    t = _turns(spark, sf)
    quality = S.answer_quality(F.col("text"), F.col("context"), F.col("g"))
    score = F.round(S.final_confidence(F.lit(0.8), F.lit(0.7), F.col("g"), quality), 6)
    return t.withColumn("score", score).select(
        "conv_id", "turn", "score", S.confidence_label(F.col("score")).alias("label"),
        S.answer_mode(F.col("text"), F.col("context"), F.col("score")).alias("mode"),
        S.initial_mode(F.lit(0.8), F.col("g"), F.col("context")).alias("first_mode"),
        S.needs_recovery(F.col("text"), F.col("score"), F.col("context")).alias("recovery"),
    )


_D = "round(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE))), 6)"
_DIST = f"d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS qlabel, {_D} AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"
_TOP = f"WITH {_DIST}, t AS (SELECT query_id, chunk_id, label, qlabel, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d {{0}} QUALIFY rank <= {{1}})"
_PAIR = rf"""
q AS (SELECT item_id AS query_id, {TERMS.format('text')} AS qt FROM benchmark),
d AS (SELECT doc_id, {TERMS.format('text')} AS dt FROM documents),
dd AS (SELECT doc_id, list_distinct(dt) AS ds, array_to_string(dt, ' ') AS blob FROM d),
s AS (SELECT query_id, doc_id, len(list_intersect(list_distinct(qt), ds)) AS o, len(list_distinct(qt)) AS nq, len(ds) AS nd,
  len(list_filter(range(1, len(qt)), lambda i: contains(blob, qt[i] || ' ' || qt[i + 1]))) > 0 AS ph FROM q, dd),
r AS (SELECT query_id, doc_id, round(least(1.0::DOUBLE, 0.7::DOUBLE * (o / nq) + 0.25::DOUBLE * (o / nd) + 0.05::DOUBLE * (CASE WHEN ph THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS score FROM s WHERE o > 0),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5)"""
_EMPTY = " OR ".join("contains(low, '" + p.replace("'", "''") + "')" for p in S.EMPTY_ANSWERS)
_FALL = " OR ".join("contains(low, '" + p.replace("'", "''") + "')" for p in S.FALLBACK_ANSWERS)
_TURN = rf"""
t AS (SELECT conv_id, turn, role, text, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations),
a AS (SELECT *, lower(trim(text)) AS low, lower(context) AS ctx, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk, regexp_extract_all(lower(context), '[a-z0-9]+') AS ck FROM t WHERE role = 'assistant'),
g AS (SELECT *, CASE WHEN len(tk) = 0 OR len(ck) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(tk, lambda x: list_contains(ck, x))) / len(tk) END AS g,
  len(list_filter(regexp_extract_all(low, '\b\d+(?:\.\d+)?\b'), lambda x: NOT contains(ctx, x))) AS bad FROM a),
q AS (SELECT *, CASE WHEN low = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE
  - (CASE WHEN len(tk) < 4 THEN 0.35 WHEN len(tk) < 8 THEN 0.15 ELSE 0 END)::DOUBLE - (CASE WHEN {_EMPTY} THEN 0.45 ELSE 0 END)::DOUBLE
  - least(0.4::DOUBLE, 0.15::DOUBLE * bad) - (CASE WHEN g < 0.2 THEN 0.3 WHEN g < 0.5 THEN 0.15 ELSE 0 END)::DOUBLE
  - (CASE WHEN contains(low, 'i don''t know') OR contains(low, 'not enough information') THEN 0.15 ELSE 0 END)::DOUBLE)) END AS quality FROM g),
f AS (SELECT *, round(0.35::DOUBLE * 0.8::DOUBLE + 0.3::DOUBLE * 0.7::DOUBLE + 0.2::DOUBLE * g + 0.15::DOUBLE * quality, 6) AS score FROM q)"""
_BLOCK = r"""'[S' || position || ']' || chr(10) || 'Title: Doc ' || doc_id || chr(10) || 'URL: ' || coalesce('https://example.com/' || source, '') || chr(10) || 'Section: ' || chr(10) || 'Rerank Score: ' || printf('%.4f', score) || chr(10) || 'Content:' || chr(10) || text"""

_PHRASES = rf"""WITH q AS (SELECT item_id AS query_id, {TERMS.format('text')} AS qt FROM benchmark),
p AS (SELECT DISTINCT query_id, qt[i] || ' ' || qt[i + 1] AS p FROM (SELECT *, unnest(range(1, len(qt))) AS i FROM q)),
d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') AS t FROM documents),
h AS (SELECT DISTINCT query_id, doc_id FROM p, d WHERE contains(t, p))
SELECT query_id, count(*) AS n_docs, min(doc_id) AS first_doc, sum(doc_id)::BIGINT AS sum_ids FROM h GROUP BY 1"""

QUERIES = {
    "vector_topk": (vector_topk, _TOP.format("", 10) + " SELECT query_id, chunk_id, distance, rank FROM t"),
    "vector_topk_filtered": (vector_topk_filtered, _TOP.format("WHERE label = qlabel", 10) + " SELECT query_id, chunk_id, distance, rank FROM t"),
    "vector_index_topk": (vector_index_topk, _TOP.format("", 10) + " SELECT query_id, chunk_id, distance, rank FROM t"),
    "vector_index_filtered": (vector_index_filtered, _TOP.format("WHERE label = qlabel", 10) + " SELECT query_id, chunk_id, distance, rank FROM t"),
    "vector_index_recall": (
        vector_index_recall,
        _TOP.format("", 10) + " SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS enough, true AS exact FROM t",
    ),
    "vector_within_distance": (vector_within_distance, _TOP.format("", 10) + " SELECT query_id, chunk_id, distance, rank FROM t WHERE distance <= 1.5"),
    "vector_multi_source_topk": (
        vector_multi_source_topk,
        f"""WITH {_DIST}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, chunk_id) AS r FROM d QUALIFY r <= 3)
        SELECT query_id, label, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
    ),
    "variant_merge_min_distance": (
        variant_merge_min_distance,
        f"""WITH d AS (SELECT q.vec_id // 100 * 100 AS query_id, q.vec_id AS v, c.vec_id AS chunk_id, {_D} AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 100 IN (0, 1)),
        t AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY distance, chunk_id) AS r FROM d QUALIFY r <= 10),
        m AS (SELECT query_id, chunk_id, min(distance) AS distance FROM t GROUP BY 1, 2)
        SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM m QUALIFY rank <= 10""",
    ),
    "retrieval_confidence": (
        retrieval_confidence,
        _TOP.format("", 10)
        + """, c AS (SELECT query_id, round(0.75::DOUBLE * max(1 / (1 + distance)) + 0.25::DOUBLE * avg(1 / (1 + distance)), 6) AS confidence, count(*) AS hits FROM t GROUP BY 1)
        SELECT query_id, confidence, hits, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS label FROM c""",
    ),
    "recall_at_k": (
        recall_at_k,
        _TOP.format("", 5) + ", h AS (SELECT query_id, max((contains('label ' || label, 'label ' || qlabel))::INT) AS hit FROM t GROUP BY 1) SELECT round(avg(hit), 4) AS recall, count(*) AS queries FROM h",
    ),
    "benchmark_sample_recall": (
        benchmark_sample_recall,
        _TOP.format("WHERE chunk_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 250)", 5)
        + ", h AS (SELECT query_id, max((contains('label ' || label, 'label ' || qlabel))::INT) AS hit FROM t GROUP BY 1) SELECT round(avg(hit), 4) AS recall, count(*) AS queries FROM h",
    ),
    "heuristic_rerank_topk": (heuristic_rerank_topk, f"WITH {_PAIR} SELECT query_id, doc_id, score, rank FROM top"),
    "rerank_margin": (
        rerank_margin,
        f"WITH {_PAIR} SELECT query_id, round(1 / (1 + exp(-(max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0)))), 6) AS confidence FROM top GROUP BY 1",
    ),
    "phrase_hits": (phrase_hits, _PHRASES),
    "phrase_index_hits": (phrase_index_hits, _PHRASES),
    "context_budget": (
        context_budget,
        rf"""WITH {_PAIR},
        h AS (SELECT top.*, trim(text) AS text, source FROM top JOIN documents USING (doc_id) WHERE trim(text) <> ''),
        o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source, text ORDER BY rank) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM o),
        b AS (SELECT *, {_BLOCK} AS block FROM n),
        w AS (SELECT *, string_split(trim(regexp_replace(block, '\s+', ' ', 'g')), ' ') AS w FROM b),
        k AS (SELECT *, greatest(1, floor(len(w) * 1.3::DOUBLE))::INT AS tokens FROM w),
        y AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY position) AS running FROM k),
        x AS (SELECT *, CASE WHEN running > 1200 THEN array_to_string(w[1:1200], ' ') ELSE block END AS shown FROM y WHERE running <= 1200 OR position = 1)
        SELECT query_id, md5(string_agg(shown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position)) AS context_md5, count(*) AS n_sources,
          sum(CASE WHEN running <= 1200 THEN tokens ELSE 0 END)::BIGINT AS used_tokens, string_agg(doc_id::VARCHAR, ',' ORDER BY position) AS sources FROM x GROUP BY 1""",
    ),
    "conversation_grounding": (conversation_grounding, f"WITH {_TURN} SELECT conv_id, turn, round(g, 6) AS grounding FROM q"),
    "answer_quality": (answer_quality, f"WITH {_TURN} SELECT conv_id, turn, round(quality, 6) AS quality FROM q"),
    "final_confidence": (
        final_confidence,
        f"""WITH {_TURN} SELECT conv_id, turn, score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS label,
        CASE WHEN low = '' OR trim(context) = '' OR {_FALL} THEN 'fallback' WHEN score >= 0.82 THEN 'complete' WHEN score >= 0.65 THEN 'partial' ELSE 'guided' END AS mode,
        CASE WHEN trim(context) = '' THEN 'fallback' WHEN 0.6::DOUBLE * 0.8::DOUBLE + 0.4::DOUBLE * g >= 0.78 THEN 'complete' WHEN 0.6::DOUBLE * 0.8::DOUBLE + 0.4::DOUBLE * g >= 0.58 THEN 'partial' ELSE 'guided' END AS first_mode,
        low = '' OR {_FALL} OR (score < 0.5 AND trim(context) <> '') AS recovery FROM f""",
    ),
}
