"""Dedup, contexts, usage, lists, pages, chunks, sources and streams on hand-made cases."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import chunker, html, shingles
from weftline.operators import context, dedup, discovery, listing, retrieval, usage
from weftline.sources import files
from weftline.streaming import usage as streams


def words(n, tag="w"):
    return [f"{tag}{i}" for i in range(n)]


def test_greedy_keep_on_a_chain(spark):
    """A~B, B~C, A not ~C: A and C stay; a copy of the dropped B goes as well."""
    a = words(60)
    b = a[:57] + words(3, "x")
    c = b[3:] + words(3, "y")
    texts = [" ".join(t) for t in (a, b, c, b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {(r["a"], r["b"]) for r in dedup.similar_pairs(docs).collect()}
    assert pairs == {(0, 1), (1, 2)}
    assert {r["doc_id"]: r["kept"] for r in dedup.greedy_keep(docs).collect()} == {0: True, 1: False, 2: True, 3: False}


def _plain_sets(texts, size=5):
    cut = [" ".join(t.lower().split()).split() for t in texts]
    return [{tuple(w[i : i + min(size, len(w))]) for i in range(max(len(w) - size + 1, 1))} if w else set() for w in cut]


def test_shingle_sets_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 37)  # words and texts that cross pieces
    texts = ["", "a", "one two", "\u00e9t\u00e9 \u4e2d\u6587 x y z \u00e9t\u00e9 \u4e2d\u6587 x y z", "ab ba ab ba ab ba ab", "l" * 200 + " b c d e f", "b c d e f " + "l" * 200, "a b c d e f", "one two"]
    got = list(shingles._sets(pa.array(texts, pa.string()).slice(0), 5)) + list(shingles._sets(pa.array(["zz", *texts]).slice(1), 5))
    plain = _plain_sets(texts) * 2
    assert [len(g) for g in got] == [len(s) for s in plain]
    for a, x in zip(got, plain, strict=True):
        assert all(len(np.intersect1d(a, b)) == len(x & y) for b, y in zip(got, plain, strict=True))


def test_similar_pairs_in_any_order_of_shingles(spark, monkeypatch):
    """Families that overlap to all degrees, at the threshold too: all pairs, whatever the sample says of rarity, and only candidates have their sets written."""
    r = random.Random(5)
    texts = [" ".join(words(24)), " ".join(words(21))] + [" ".join(words(24)[:k] + words(24 - k, f"x{k}")) for k in range(14, 24)]
    for f in range(6):
        base = words(60, f"f{f}-")
        texts += [" ".join(base[: 60 - k] + words(k, f"{f}.{k}.")) for k in range(0, 12, 2)] + [" ".join(base).upper()]
    texts += [" ".join(r.choice("abcd") for _ in range(40)) for _ in range(8)] + ["short text", "Short  text", "", " ", None]
    texts += [" ".join(words(30, f"lone{i}-")) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets, first = _plain_sets([t or "" for t in texts]), {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join((t or "").lower().split()), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(want) > 15 and (0, 1) in want  # 17 of 20
    written = {}

    def persisted(df, name, write=dedup.persisted):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(dedup, "persisted", persisted)
    for sample, common in ((20_000, 200_000), (30, 3)):
        monkeypatch.setattr(dedup, "SAMPLE", sample, raising=False)
        monkeypatch.setattr(dedup, "COMMON", common, raising=False)
        got = [(x["a"], x["b"]) for x in dedup.similar_pairs(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert written["shingle-sets"].count() < 60


def test_distance_filter(spark):
    hits = spark.createDataFrame([(1, 0.8), (2, 1.4), (3, None)], "chunk_id long, distance double")
    assert [r["chunk_id"] for r in retrieval.within_distance(hits, 1.15).collect()] == [1]
    assert retrieval.within_distance(hits, None).count() == 3
    rescued = retrieval.within_distance(hits, 1.15, F.col("chunk_id") == 3)
    assert sorted(r["chunk_id"] for r in rescued.collect()) == [1, 3]


def test_vector_topk_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "chunk_id long, embedding array<float>, label int")
    q = e.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(e, q, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.vector_topk(e, q, 3).collect())) == want
    assert [r["chunk_id"] for r in retrieval.vector_topk(e, q.where("query_id = 4"), 3, True).orderBy("rank").collect()] == [4, 2, 6]


def test_oversized_context_is_trimmed(spark):
    hits = spark.createDataFrame([(1, 1, 7, "t", "u", "s", "word " * 500, 0.5), (1, 2, 8, "t", "u", "s", "more", 0.4)], "query_id long, rank int, chunk_id long, title string, url string, section string, text string, score double")
    r = context.build_contexts(hits, 5).head()
    assert r["n_sources"] == 1 and r["sources"] == [7] and len(r["context"].split()) == 5


def test_quota_edges(spark):
    rows = [(90, 100, "active"), (100, 100, "active"), (89, 100, "limited"), (500, 100, "suspended")]
    df = spark.createDataFrame(rows, "t int, l int, s string")
    got = [r[0] for r in df.select(usage.quota_state(F.col("t"), F.col("l"), F.col("s"))).collect()]
    assert got == ["limited", "cooldown", "active", "suspended"]


def test_lists(spark):
    df = spark.createDataFrame([(1, None), (2, 10), (3, 9)], "id int, v int")
    assert [r["id"] for r in listing.page(df, [listing.text_order("v", False)], 1, 0).collect()] == [1, 2, 3]  # 0 is the default size
    assert [r["id"] for r in listing.page(df, [listing.text_order("v", False)], 2, 2).collect()] == [3]
    assert [r["id"] for r in listing.page(df, [listing.text_order("v", True)], 1, 1000).collect()] == [3, 2, 1]  # 9 > 10 as text
    assert listing.clamped_page(df, [F.col("id")], 99, 2).head()["id"] == 3


def test_snapshot_tombstones(spark):
    old = spark.createDataFrame([("a", "success", "1"), ("b", "success", "2")], "url string, status string, hash string")
    now = old.where("url = 'a'")
    got = {r["url"]: r["status"] for r in listing.snapshot_diff(old, now, "url", F.current_timestamp()).collect()}
    assert got == {"a": "success", "b": "tombstoned"}


def test_snapshot_rows_that_repeat_a_key(spark):
    """Two rows of a key before and three now are three rows, and two where the key is gone."""
    before = spark.createDataFrame([("a", "ok", "1"), ("a", "ok", "2"), ("b", "ok", "3"), ("b", "ok", "4"), ("c", "ok", "5")], "url string, status string, hash string")
    now = spark.createDataFrame([("a", "ok", "6"), ("a", "ok", "6"), ("a", "ok", None), ("c", "new", None), (None, "ok", "7")], "url string, status string, hash string")
    got = listing.snapshot_diff(before, now, "url", F.lit("t")).collect()
    want = [("a", "ok", "2", None), ("a", "ok", "6", None), ("a", "ok", "6", None), ("b", "tombstoned", "3", "t"), ("b", "tombstoned", "4", "t"), ("c", "new", "5", None), (None, "ok", "7", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))



PAGE = """<!-- source_url: https://example.com/about -->
<html lang="en"><head><title>About us</title><meta name="description" content="Who we are"><link rel="canonical" href="https://example.com/c"></head>
<body><nav>Menu</nav><main><h1>About</h1><p>We build <b>small</b> tools for people who like to read the words of this long paragraph about us.</p>
<h2>Plans</h2><ul><li>One</li><li>Two</li></ul><pre>x = 1
y = 2</pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></main><footer>Legal</footer></body></html>"""


def test_page_extraction():
    root = html.parse(PAGE)
    main = html.main_content(html.parse(PAGE))
    m = html.metadata(PAGE, root, main)
    assert (m["title"], m["url"], m["language"], m["headings"]) == ("About us", "https://example.com/about", "en", ["About", "Plans"])
    text = html.to_markdown(main)
    assert "# About\n\nWe build **small** tools" in text and "- One\n- Two" in text and "```\nx = 1\ny = 2\n```" in text and "| A | B |\n| --- | --- |\n| 1 | 2 |" in text
    assert "Menu" not in text and "Legal" not in text


def test_entities_layers():
    offers = [{"price": "12,5", "priceCurrency": "aed", "availability": "in stock"}, {"name": "Big", "price": "20"}]
    ld = json.dumps({"@graph": [{"@type": "https://schema.org/Product", "name": "Pot", "offers": offers}, {"@type": "FAQPage", "mainEntity": {"name": "Q?", "acceptedAnswer": {"text": "A"}}}]})
    page = f'<meta property="og:type" content="product"><meta property="og:title" content="Other"><script type="application/ld+json">{ld}</script><div itemscope itemtype="x/Person"><i itemprop="name">Ann</i></div>'
    e = html.entities(html.parse(page))
    assert (e["product_name"], e["product_price"], e["product_currency"], e["product_availability"]) == ("Pot", "12.5", "AED", "InStock")
    assert json.loads(e["product_variants"])[1] == {"name": "Big", "price": "20"}
    assert json.loads(e["faq_pairs"]) == [{"q": "Q?", "a": "A"}] and json.loads(e["people"]) == [{"name": "Ann"}] and e["entity_type"] == "FAQPage"


def test_blocks_and_headings():
    b = chunker.blocks("# Title\n## Section\nParagraph\n\n#### Deep\ntext\n```py\n# not a heading\n\nx\n```\n- a\n- b\n| a | b |\n")
    assert [(x.kind, x.path) for x in b] == [
        ("heading", ("Title",)), ("heading", ("Title", "Section")), ("text", ("Title", "Section")), ("heading", ("Title", "Section", "Deep")),
        ("text", ("Title", "Section", "Deep")), ("code", ("Title", "Section", "Deep")), ("list", ("Title", "Section", "Deep")),
    ]


def test_chunks_of_paragraphs_code_and_tables():
    text = "\n\n".join(f"Paragraph {i} has some words in it that fill the page." for i in range(80))
    c = chunker.chunk(text, "h" * 64, title="T", largest=120, smallest=10, overlap=20)
    assert len(c) > 5 and all(chunker.tokens(x["raw_content"]) <= 120 for x in c)
    assert c[0]["chunk_id"] == "h" * 12 + "-0001" and c[0]["content"].startswith("Page: T\nSection: T\nEntity Type: Text Block\nContent:\n")
    code = "```python\n" + "\n".join(f"value_{i} = {i} + 1" for i in range(80)) + "\n```"
    c = chunker.chunk(code, "h" * 64, largest=80, smallest=10, overlap=10)
    assert len(c) > 1 and all(x["raw_content"].startswith("```python") and x["raw_content"].endswith("```") and x["content_type"] == "code" for x in c)
    assert {x["split_count"] for x in c} == {len(c)} and [x["split_index"] for x in c] == list(range(1, len(c) + 1))
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | value {i} |" for i in range(60))
    c = chunker.chunk(table, "h" * 64, largest=90, smallest=10)
    assert len(c) > 1 and all(x["raw_content"].startswith("| a | b |\n| --- | --- |") for x in c)


def test_chunks_small_cases():
    assert chunker.chunk("# Only a heading", "h") == []
    one = "Some words that make one paragraph of a fair size for the test of repeated paragraphs, long enough to count as one chunk by itself alone."
    assert len(chunker.chunk(f"{one}\n\n{one}", "h", largest=40, smallest=5, overlap=0)) == 1
    assert chunker.limits(50, 500, 999) == (100, 99, 99)


def test_chunk_files_round_trip(spark, tmp_path):
    record = {"chunk_id": "a", "content": "text", "title": "T", "heading_path": ["A", "", "B"], "token_count": 3}
    (tmp_path / "x.chunks.json").write_text(json.dumps([record, {"chunk_id": "", "content": "no id"}]))
    (tmp_path / "y.chunks.json").write_text("not json")
    got = files.read_chunks(spark, str(tmp_path), {"context_id": "c1"}, "p").collect()
    assert [(r["chunk_id"], r["metadata"]) for r in got] == [("p:a", {"title": "T", "token_count": "3", "heading_path": "A > B", "context_id": "c1"})]
    index = spark.createDataFrame(got)
    assert files.delete_where(index, context_id="c1").count() == 0 and files.delete_where(index, context_id="c2").count() == 1


def test_sitemap_and_manifest(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.b/en/x </loc></url><url><loc>https://a.b/fr/x</loc></url><url><loc>/rel</loc></url><url><loc>https://a.b/en/x</loc></url></urlset>")
    assert sorted(r["url"] for r in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect()) == ["https://a.b/en/x", "https://a.b/fr/x"]
    assert [r["url"] for r in files.read_sitemap(spark, str(tmp_path / "s.xml"), True).collect()] == ["https://a.b/en/x"]
    (tmp_path / "m.json").write_text(json.dumps({"https://a.b/": {"status": "success", "content_hash": "h"}}))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).head()["url"] == "https://a.b/"
    (tmp_path / "bad.json").write_text("{")
    assert files.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0


def test_discovery_bounds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["depth"]) for r in discovery.discover(links, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert discovery.discover(links, seeds, 1).count() == 2
    assert sorted(r["url"] for r in discovery.discover(links, seeds, 0, 3).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("files_per_trigger", [None, 1])
def test_streams_over_late_batches(spark, tmp_path, files_per_trigger):
    """A late event of an earlier day still counts, whatever the micro-batches."""
    path = str(tmp_path / "events.parquet")
    for rows in ([(1, "2024-01-02 01:00:00", 50.0)], [(1, "2024-01-01 23:00:00", 7.9), (2, "2024-01-02 00:00:00", -3.0)], [(1, "2024-01-02 02:00:00", 45.0)]):
        spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    got = streams.run_to_table(streams.rollup_stream(streams.read_stream(spark, path, files_per_trigger)), ["day", "client_id"], "t")
    assert sorted((str(r["day"]), r["client_id"], r["tokens"], r["requests"]) for r in got.collect()) == [("2024-01-01", 1, 7, 1), ("2024-01-02", 1, 95, 2), ("2024-01-02", 2, 0, 1)]
    quota = streams.run_to_table(streams.quota_stream(streams.read_stream(spark, path, files_per_trigger), 100), ["client_id"], "q")
    assert {(r["client_id"], r["tokens"], r["status"]) for r in quota.collect()} == {(1, 95, "limited"), (2, 0, "active")}


def test_clean_for_storage():
    got = html.clean_for_storage('<html><head><style>x</style></head><body class="a&amp;b"><p>1 &lt; 2<br>3</p><script>var a = "<p>";</script><svg><g/></svg></body></html>')
    assert got == '<html><head></head><body class="a&amp;b"><p>1 &lt; 2<br/>3</p></body></html>'


def test_deep_nesting_ends_no_job():
    """Pages and their JSON may nest as deep as they like."""
    deep = "<div>" * 3000 + "<span>" * 3000 + "deep words"
    assert html.to_markdown(html.main_content(html.parse(f"<body>{deep}</body>"))) == "deep words\n"
    for data in ("[" * 100_000, '{"@type":"Product","name":' + "[" * 5000 + "]" * 5000 + "}", '{"a":' * 50_000):
        page = f'<html><head><script type="application/ld+json">{data}</script><script type="application/ld+json">{{"@type":"Event","name":"E"}}</script></head></html>'
        assert html.entities(html.parse(page))["org_name"] == "E"
    lists = html.to_markdown(html.parse("<ul><li>x" * 500))
    assert lists.count("- x") == 500


def test_chunk_spans_by_hand():
    """Overlap, a piece between runs, an idle heading, and a short end, on units of known size."""
    unit = lambda n, kind="text": chunker.Block(" ".join(["w"] * n), (), kind)
    spans = lambda units, pieces=None, **kw: list(chunker.spans(units, pieces or [False] * len(units), **{"largest": 13, "smallest": 3, "overlap": 4} | kw))
    assert spans([unit(3), unit(3), unit(3), unit(3)]) == [(0, 3), (2, 4)]
    assert spans([unit(3), unit(3), unit(3), unit(10)]) == [(0, 3), (3, 4)]
    assert spans([unit(3), unit(8), unit(8), unit(3)], [False, True, True, False]) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert spans([unit(1, "heading"), unit(10)], largest=13) == [(1, 2)] and spans([unit(1, "heading")]) == []
    assert spans([unit(3)] * 4, overlap=0) == [(0, 3), (3, 4)] and spans([]) == []


def test_sitemaps_name_each_other(spark, tmp_path):
    """A ring, a file that is missing, one that is broken, one that nothing names; each is visited once."""
    from weftline.sources.files import read_sitemap_tree

    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap>\n<loc> https://a.org/{n}?x=1 </loc><lastmod>2024</lastmod></sitemap>" for n in names) + "</sitemapindex>"
    pages = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    files = {
        "root.xml": index("one.xml", "gone.xml", "root.xml"), "one.xml": index("two.xml", "bad.xml", "root.xml"), "two.xml": pages("https://a.org/p?a=1&amp;b=2", "https://a.org/fr/q", "/relative"),
        "bad.xml": "<urlset><url><loc>https://a.org/r</loc>", "other.xml": pages("https://a.org/never"),
    }
    for n, x in files.items():
        (tmp_path / n).write_text(x)
    read = lambda **kw: sorted(r[0] for r in read_sitemap_tree(spark, str(tmp_path), "root.xml", **kw).collect())
    assert read() == ["https://a.org/fr/q", "https://a.org/p?a=1&b=2", "https://a.org/r"]
    assert read(english_only=True) == ["https://a.org/p?a=1&b=2", "https://a.org/r"]
