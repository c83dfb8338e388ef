"""Phrases by postings against a substring search."""

import random
import re

from weftline.functions.text import QUERY_STOPWORDS
from weftline.operators import postings, retrieval

DOC, QUERY = "doc_id long, text string, extra string", "query_id long, text string"


def plain(docs, queries):
    texts = [(i, " ".join(re.findall("[a-z0-9]+", (t or "").lower()))) for i, t, _ in docs]
    out = set()
    for q, t in queries:
        terms = [x for x in re.findall("[a-z0-9]+", (t or "").lower()) if len(x) > 2 and x not in QUERY_STOPWORDS]
        out |= {(q, i) for i, text in texts for a, b in zip(terms, terms[1:], strict=False) if f"{a} {b}" in text}
    return sorted(out, key=repr)


def made():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60))), "x") for i in range(120)]
    docs += [(200, "A smart heron; art\nherring", "x"), (201, None, "x"), (202, "", "x"), (203, "one", "x"), (204, "the art, her-on", "x"), (None, "smart heron", "x"), (200, "smart heron", "again")]
    docs += [(300 + i, "common phrase here", "x") for i in range(50)]
    queries = [(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(40)]
    queries += [(100, "art her"), (101, None), (102, "heron"), (103, "art of the heron"), (104, "common phrase"), (104, "smart heron"), (None, "smart heron")]
    return docs, queries


def pairs(df):
    return sorted(((r["query_id"], r["doc_id"]) for r in df.collect()), key=repr)


def test_phrases_are_substrings(spark, tmp_path, monkeypatch):
    docs, queries = made()
    d, q = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(queries, QUERY)
    want = plain(docs, queries)
    assert pairs(retrieval.phrase_hits(d, q)) == want and len(want) > 100 and (100, 200) in want
    index = postings.PhraseIndex.build(d, f"file://{tmp_path}/phrases")
    assert pairs(index.search(q)) == want
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 1)
    assert pairs(postings.PhraseIndex(spark, f"file://{tmp_path}/phrases").search(q)) == want


def test_phrases_of_nothing(spark, tmp_path):
    docs, queries = made()
    d, q = spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, QUERY)
    assert retrieval.phrase_hits(d, q.limit(0)).count() == 0 and retrieval.phrase_hits(d.limit(0), q).count() == 0
    assert postings.PhraseIndex.build(d.limit(0), f"file://{tmp_path}/none").search(q).count() == 0
    assert postings.PhraseIndex.build(d, f"file://{tmp_path}/some").search(q.where("query_id = 102")).count() == 0


def test_search_has_no_cross_join(spark):
    docs, queries = made()
    plan = retrieval.phrase_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, QUERY))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
