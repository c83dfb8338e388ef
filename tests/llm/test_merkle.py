"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle

from .cases import by_id, documents, frame

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The top of a tree, and for each lowest node its siblings (left, right) by level."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for k in range(len(run)):
                for i in below[lo + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            owners.append([i for k in range(len(run)) for i in below[lo + k]])
        nodes, below = up, owners
    return nodes[0] if nodes else None, paths


def plain(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by = defaultdict(list)
    for i, t, lang, s, n in rows:
        leaf = h(said(i), said(s), said(lang), said(n), said(t))
        small = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        other = h(said(i), said(s), said(lang), said(n), said(small)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        by[s].append(((i is not None, i or 0, leaf), i, leaf, other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, paths = [], {}
    for s in names:
        by[s].sort(key=lambda x: x[0])
        top, paths[s] = tree([x[2] for x in by[s]])
        tops.append(top)
    root, upper = tree(tops)
    out = []
    for s, top, above in zip(names, tops, upper, strict=True):
        for (_, i, leaf, other), path in zip(by[s], paths[s], strict=True):
            path = path + above
            node = other
            for left, right in path:
                node = h(left, node, right)
            out.append((i, leaf, top, root, h(*(x for p in path for x in p)), node, node == root))
    return sorted(out, key=repr)


def full(rows):
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.mark.parametrize("case", ["odd", "many sources", "one row", "one source of 17", "copies"])
def test_manifest(spark, case):
    rows = {
        "odd": documents() + [(7, None, None, None)] * 3 + [(None, "T", "en", "a")] * 20,
        "many sources": [(i, f"Text {i}", "en", f"s{i % 300:03d}" if i % 7 else ["", "é", "z", None][i % 4]) for i in range(700)],
        "one row": [(5, "A", "en", None)],
        "one source of 17": [(i, "Abc", None, "x") for i in range(17)],
        "copies": [(1, "Same", "en", "a")] * 400 + [(2, "b", "en", "b")],
    }[case]
    got = by_id(merkle.verification(frame(spark, rows).repartition(5)), *COLUMNS)
    assert got == plain(full(rows))
    assert case == "one row" or {g[-1] for g in got} <= {True, False}


def test_tampering_is_seen(spark):
    rows = [(i, "Some Text" if i % 2 else "small", "en", "a") for i in range(100)]
    bad = {r["doc_id"] for r in merkle.verification(frame(spark, rows)).where("NOT verified").collect()}
    assert bad == {i for i in range(100) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0} and bad


def test_manifest_of_nothing_and_with_ids_of_other_types(spark):
    assert merkle.verification(frame(spark, [])).count() == 0
    docs = frame(spark, documents()).withColumn("place", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("other", F.lit(2))
    assert by_id(merkle.verification(docs), *COLUMNS) == plain(full(documents()))
    assert by_id(merkle.manifest(docs), "doc_id", "leaf") == [(g[0], g[1]) for g in by_id(merkle.verification(docs), "doc_id", "leaf")]


def test_many_sources_take_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 5)
    rows = [(i, f"Text {i}", "en", f"s{i % 40}" if i % 3 else None) for i in range(300)]
    assert by_id(merkle.verification(frame(spark, rows)), *COLUMNS) == plain(full(rows))
