"""What must last or stay bounded: indexes that are opened again, hot keys, long texts, odd columns, planted personal data."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontamination, exact_dedup, kernels, mixing, near_dedup, pii, shared, sharding, sparse_windows, substring_dedup, suffix_dedup

from .cases import by_id, documents, frame
from .test_exact import COLUMNS, check_shards, decon_brute, near_brute, substring_brute, suffix_brute


# -- indexes --------------------------------------------------------------------


def test_digest_index_is_opened_by_its_path(spark, tmp_path):
    path = f"file://{tmp_path}/digests"
    parts = [[(1, "a b", "en", "s"), (2, "c", "en", "s")], [(3, "ab", "en", "s"), (4, "d", "en", "s")], [(5, "a  b", "en", "s"), (6, "c", "en", "s")]]
    sizes = []
    for i, part in enumerate(parts):
        session = spark if i < 2 else spark.newSession()
        index = exact_dedup.DigestIndex(session, path)
        out = {r["doc_id"]: r for r in exact_dedup.decisions(frame(session, part), index).collect()}
        sizes.append({k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in out.items()})
    assert sizes == [{1: (1, 1, True), 2: (2, 1, True)}, {3: (1, 2, False), 4: (4, 1, True)}, {5: (1, 3, False), 6: (2, 2, False)}]
    again = exact_dedup.DigestIndex(spark, path)
    want = {(r["digest"], r["keep_id"], r["group_size"]) for r in again.read().collect()}
    assert len(want) == 3 and sorted(w[2] for w in want) == [1, 2, 3]
    again.compact()
    assert len(again.names) == 1 and {(r["digest"], r["keep_id"], r["group_size"]) for r in exact_dedup.DigestIndex(spark, path).read().collect()} == want
    again.vacuum()
    assert exact_dedup.deduplicate(frame(spark, parts[0] + [(9, "e", "en", "s")]), exact_dedup.DigestIndex(spark, path)).select("doc_id").collect()[0][0] == 9


def test_digest_index_survives_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/digests"
    exact_dedup.deduplicate(frame(spark, [(1, "a", "en", "s")]), exact_dedup.DigestIndex(spark, path))
    index = exact_dedup.DigestIndex(spark, path)
    monkeypatch.setattr(shared.Manifest, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        exact_dedup.deduplicate(frame(spark, [(2, "b", "en", "s")]), index)
    monkeypatch.undo()
    assert exact_dedup.DigestIndex(spark, path).read().count() == 1
    assert exact_dedup.deduplicate(frame(spark, [(2, "b", "en", "s")]), exact_dedup.DigestIndex(spark, path)).count() == 1


def test_fingerprint_index_is_opened_by_its_path(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/fingerprints"
    rows = [r for r in documents()[:-2] if r[0] is not None]
    got, past = [], None
    for i, part in enumerate((rows[:20], rows[20:45], rows[45:])):
        session = spark if i < 2 else spark.newSession()
        batch = frame(session, part)
        index = substring_dedup.FingerprintIndex(session, 8, path, hot=[17])
        if i == 1:  # a crash before the commit leaves the state before it
            monkeypatch.setattr(shared.Manifest, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("crash")))
            with pytest.raises(RuntimeError):
                substring_dedup.remove_known(batch, index, past)
            monkeypatch.undo()
            index = substring_dedup.FingerprintIndex(session, 99, path)
            assert index.buckets == 8 and index.state["hot"] == [17] and len(index.runs) == 1
        got += by_id(substring_dedup.remove_known(batch, index, past), *COLUMNS)
        past = batch if past is None else past.unionByName(batch)
    assert sorted(got, key=repr) == sorted(substring_brute(rows), key=repr)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared.shared_folder(Session())


# -- mixing ---------------------------------------------------------------------


def test_mixing_cuts_between_equal_rows(spark):
    rows = [(7, "one two three four", "en", "a")] * 1000 + [(8, "x " * 900, "en", "b")] * 3 + [(None, "p q r", "en", "c")] * 50
    out = mixing.mix_report(frame(spark, rows).repartition(5)).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, most in (("a", 4), ("b", 900), ("c", 3)):
        assert abs(taken[s] - target[s]) <= most / 2 + 1e-6, (s, taken[s], target[s])
    again = mixing.mix_report(frame(spark, rows).repartition(3)).collect()
    count = lambda o: Counter((r["doc_id"], r["size"], r["taken"]) for r in o)
    assert count(again) == count(out)
    mixed = mixing.expand(mixing.mix(frame(spark, rows)), frame(spark, rows).columns)
    assert mixed.count() == sum(r["copies"] for r in out)


@pytest.mark.parametrize("weight", [1.0, 0.1, 0.01])
def test_mixing_sorts_few_rows_whatever_the_weights(spark, monkeypatch, weight):
    """The interval in which a budget ends is made finer until it is small, for any spread of keys."""
    docs = spark.range(60_000).selectExpr("id doc_id", "'w w w' text", "'en' lang", "if(id % 4 = 0, 'a', 'b') source", "5L n_chars")
    seen = []
    real = mixing._in_edge

    def watch(sized, edge):
        seen.append(edge.agg(F.max("n") if "n" in edge.columns else F.lit(None)).head()[0])
        return real(sized, edge)

    monkeypatch.setattr(mixing, "_in_edge", watch)
    out = mixing.mix_report(docs, F.lit(weight)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert seen[-1] <= mixing.BUCKET_ROWS
    assert all(abs(r["t"] - r["g"]) <= 1.5 + 1e-6 for r in out)


CLASHES = ("size", "source_size", "target", "copies", "taken", "TAKEN_", "__kept", "__text", "own", "__hot", "__s", "digest", "kept_id", "n")


def clashing(spark, rows):
    df = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return df


def untouched(out):
    return all(r[c] == f"{i}-{'null' if r['doc_id'] is None else r['doc_id']}" for r in out for i, c in enumerate(CLASHES))


def test_clashing_columns_pass_through(spark, tmp_path):
    rows = [(i, f"text {i} of some words " * 3, "en", f"s{i % 2}") for i in range(30)] + [(3, "text 3 of some words " * 3, "en", "s1"), (None, None, None, None)]
    docs = clashing(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(set(map(str.lower, mixed.columns))) == len(mixed.columns)
    bench = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (mixing.expand(mixed, docs.columns), exact_dedup.deduplicate(docs), near_dedup.deduplicate(docs), decontamination.remove_contaminated(docs, bench)):
        assert out.columns == docs.columns and untouched(out.collect())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert untouched(docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_over_odd_tables(spark, tmp_path):
    rows = documents()
    for name, some in (("odd", rows + [rows[2]] * 4 + [(None, None, None, None)] * 3), ("empty", [])):
        d = tmp_path / name
        frame(spark, some).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        assert (corpus_pipeline.run(spark, str(d)).count() > 0) is bool(some)


# -- words that patterns of bytes would make equal -----------------------------


def alternating(n, first):
    """Thue-Morse words of two letters: polynomials modulo 2**64 can't tell them apart from 1,024 bytes on."""
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


def test_long_words_of_two_letters_differ(spark):
    plain = [f"w{k}" for k in range(12)]
    a, b = alternating(4096, 0), alternating(4096, 1)
    rows = [(1, " ".join([*plain[:6], a, *plain[6:]]), "en", "a"), (2, " ".join([*plain[:6], b, *plain[6:]]), "en", "a"), (3, " ".join([*plain[:6], a, *plain[6:]]), "en", "a")]
    docs = frame(spark, rows)
    assert by_id(substring_dedup.remove_known(docs), "doc_id", "n_words", "n_removed") == [(1, 13, 0), (2, 13, 0), (3, 13, 13)]
    assert by_id(near_dedup.near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert by_id(decontamination.contamination(docs, bench), "doc_id", "n_hit") == [(1, 13), (2, 0), (3, 13)]


def test_word_hashes_in_pieces(monkeypatch):
    """Words longer than a piece have the hash that they have in one piece."""
    data = np.frombuffer(f"xy {alternating(900, 0)} z {alternating(333, 1)}  q".encode(), dtype=np.uint8)
    whole = kernels.word_hashes(data, np.array([0, len(data)]), kernels.NOT_SPACE, False)
    monkeypatch.setattr(kernels, "CHUNK", 50)
    for x, y in zip(whole, kernels.word_hashes(data, np.array([0, len(data)]), kernels.NOT_SPACE, False), strict=True):
        assert (x == y).all()
    assert len(set(whole[2].tolist())) == 5


# -- hot keys and long texts ------------------------------------------------------


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base, "en", "a")] * 3 + [(2, base + " x", "en", "a")] + [(None, "no id here at all yet", "en", "a")] * 2 + [(None, "another one that has no id", "en", "a")]
    kept = near_dedup.deduplicate(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1] and len(kept) == 3


def test_near_dedup_confirms_one_link_whatever_the_repetitions(spark, monkeypatch):
    base = " ".join(f"w{k}" for k in range(60))
    confirmed, confirm = [], near_dedup.confirm

    def counted(*args):
        out = confirm(*args)
        confirmed.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "confirm", counted)
    docs = frame(spark, [(1, base, "en", "a"), (2, base + " x", "en", "a")]).crossJoin(spark.range(1000)).drop("id")
    out = near_dedup.near_duplicates(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1000), (2, 1, 1000)] and sum(confirmed) == 1


def test_near_dedup_splits_hot_hubs(spark, monkeypatch):
    """A template family whose members share buckets, joined with every key split."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(120), i % 9):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(w), "en", "a"))
    want = {i: w[2] for i, w in near_brute(rows).items()}
    for module in (shared, near_dedup):
        monkeypatch.setattr(module, "KEY_ROWS", 7)
    monkeypatch.setattr(near_dedup, "SPLIT_ROWS", 5)
    monkeypatch.setattr(shared.join_split, "__defaults__", (7,))
    monkeypatch.setattr(shared, "HOT_GROUPS", 10**9)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


@pytest.fixture(scope="module")
def crowded():
    """One line in every document, with other words around it, and one text of a megabyte."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    line = " ".join(word() for _ in range(60))
    rows = [(i, f"{' '.join(word() for _ in range(8))} {line} {' '.join(word() for _ in range(8))}", "en", "a") for i in range(1, 1201)]
    long = " ".join(word() for _ in range(200_000))
    rows.append((2000, long[:600_000] + line + long[600_000:] + " " + rows[3][1], "en", "b"))
    return rows


def test_suffix_dedup_deals_a_hot_suffix_over_buckets(spark, crowded, monkeypatch):
    monkeypatch.setattr(sparse_windows, "BUCKET_RECORDS", 1000)
    monkeypatch.setattr(suffix_dedup, "SAMPLES", 16)
    docs = frame(spark, crowded).repartition(6)
    assert len(crowded[-1][1]) > 1 << 20
    spec = sparse_windows.Spec("bytes", suffix_dedup.LENGTH, suffix_dedup.ANCHOR, "anywhere")
    rows = sparse_windows.keyed(docs)
    cut = suffix_dedup.splitters(rows, spec, sparse_windows.bucket_count(rows, spec))
    assert len(set(cut)) < len(cut)  # a suffix that is several splitters
    got = by_id(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(suffix_brute(crowded), key=repr)


def test_substring_dedup_deals_a_hot_lead_over_buckets(spark, crowded, monkeypatch):
    monkeypatch.setattr(sparse_windows, "BUCKET_RECORDS", 1000)
    docs = frame(spark, crowded).repartition(6)
    rows = sparse_windows.keyed(docs)
    assert sparse_windows.frequent_leads(rows, substring_dedup.SPEC, sparse_windows.bucket_count(rows, substring_dedup.SPEC))
    assert by_id(substring_dedup.remove_known(docs), *COLUMNS) == sorted(substring_brute(crowded), key=repr)


def test_long_texts_elsewhere(spark, crowded):
    docs = frame(spark, crowded[-2:])
    items = [(1, crowded[3][1])]
    out = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert by_id(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(decon_brute(crowded[-2:], items), key=repr)
    assert near_dedup.near_duplicates(docs).where("kept").count() == 2
    assert {r["doc_id"]: r["size"] for r in mixing.mix_report(docs).collect()}[2000] == len(crowded[-1][1].split())


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(None, "same", "en", "a")] * 1500 + [(i, f"t{i}", "en", "a") for i in range(300)]
    check_shards(sharding.shard(frame(spark, rows).repartition(4)).collect(), rows)


# -- decontamination --------------------------------------------------------------


def test_a_null_item_and_one_named_null_are_two(spark):
    docs = frame(spark, [(1, "so it was said", "en", "a")])
    items = spark.createDataFrame([(None, "it was"), ("null", "was said"), ("null", "was said")], "item_id string, text string")
    for block in (1 << 20, 3):
        assert decontamination.contamination(docs, items, block_bytes=block).head()["n_items"] == 2


def test_a_block_of_windows_stays_small():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(5000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontamination.Windows(iter(items), 13, 3)
    windows.choose({q: [1] * len(v) and __import__("numpy").ones(len(v), dtype="int64") for q, v in windows.vocabulary.items()})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # at most 300 MB for a full block
    assert peak * decontamination.BLOCK_BYTES / size < 300e6 and windows.nbytes() * decontamination.BLOCK_BYTES / size < 100e6


# -- personal data ------------------------------------------------------------------


def planted(seed, n):
    """(text, true spans): disguised and run-on data, with and without cue words, and numbers and words that only look like it."""
    r=random.Random(seed)
    part = ["ka","lo","mi","ne","ru","ta","so","vi","de","bu"]
    w=lambda: "".join(r.choice(part) for _ in range(r.randint(1,4)))
    d=lambda k: "".join(r.choice("0123456789") for _ in range(k))
    def card(first, k):
        b=first+d(k-len(first)-1)
        for c in "0123456789":
            if pii.luhn(b+c): return b+c
    ip=lambda: [str(r.randint(32,255)) for _ in range(4)]
    area=lambda: r.choice("23456789")+d(2)
    pos=[
     ("email", lambda: (lambda a,s: f"{w()}{r.choice(['','.','_'])}{w()}{s[0]}{w()}{s[1]}{r.choice(['com','org','net','de','io'])}")(0, r.choice([("[at]","[dot]"),(" at "," dot "),("(at)","."),(" (at) "," (dot) "),("{at}","{dot}"),(" @ ","."),("＠","."),(" AT "," DOT ")]))),
     ("ip", lambda: r.choice(["[.]","(dot)"," dot "," . ","[dot]"]).join(ip())),
     ("card", lambda: (lambda c: r.choice([c, ".".join(c[i:i+4] for i in range(0,16,4)), "  ".join(c[i:i+4] for i in range(0,16,4))]))(card(r.choice(["4","51","55"]),16))),
     ("card", lambda: r.choice([card("37",15), card("34",15)])),
     ("phone", lambda: r.choice([f"({area()}) {d(3)}-{d(4)}", f"{area()}-{d(3)}-{d(4)}", f"{area()}.{d(3)}.{d(4)}", f"0{r.choice('123456789')}{d(2)} {d(7)}", f"0049 {d(3)} {d(7)}", f"0{r.choice('123456789')}{d(2)}/{d(6)}"])),
    ]
    glue=[("card", lambda: (d(r.randint(2,6))+" ", card("4",16), "")), ("phone", lambda: ("", f"+1 ({area()}) {d(3)}-{d(4)}", " "+d(8)))]
    neg=[lambda: f"order {d(16)}", lambda: f"version {r.randint(1,9)} . {r.randint(1,9)} . {r.randint(0,9)} . {r.randint(0,9)}", lambda: d(15), lambda: d(14), lambda: f"{d(3)} {d(4)} {d(3)}", lambda: f"{r.choice('01')}{d(2)} 0{d(2)} {d(4)}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
         lambda: f"1{d(2)}-{d(3)}-{d(4)}", lambda: f"| {d(4)} | {d(4)} {d(4)} {d(4)} {d(4)} |", lambda: f"meet at {w()} dot {w()}", lambda: f"{w()} [at] {w()}", lambda: "900 . 800 . 700 . 600", lambda: f"tracking {d(17)}", lambda: f"total {d(3)}.{d(3)}.{d(4)}"]
    cue={"email":["mail me at","email:","contact"],"ip":["host","server ip"],"card":["card","visa"],"phone":["call","tel:"]}
    out=[]
    for i in range(n):
        t=" ".join(w() for _ in range(r.randint(5,40)))+" "
        truth=set(); x=r.random()
        if x<.25:
            k,f=r.choice(pos); v=f()
            if r.random()<.5: t+=r.choice(cue[k])+" "
            truth.add((k,len(t),len(t)+len(v))); t+=v
        elif x<.35:
            k,f=r.choice(glue); a,v,z=f(); truth.add((k,len(t)+len(a),len(t)+len(a)+len(v))); t+=a+v+z
        elif x<.7: t+=r.choice(neg)()
        t+=" "+" ".join(w() for _ in range(r.randint(1,20)))
        out.append((t,truth))
    return out


def test_pii_finds_what_the_base_patterns_miss(spark):
    data = planted(5, 2500)
    rows = [(i, t, "en", "a") for i, (t, _) in enumerate(data)]
    out = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    right = wrong = missed = base_alone = 0
    for i, (t, truth) in enumerate(data):
        base = [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)]
        base_alone += len(truth & set(base))
        truth = {x for x in truth if not any(b[0] == x[0] and b[1] <= x[1] and x[2] <= b[2] for b in base)}
        added = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in out[i].split(",") if x)} - set(base)
        right, wrong, missed = right + len(truth & added), wrong + len(added - truth), missed + len(truth - added)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
    assert base_alone < 0.1 * right
