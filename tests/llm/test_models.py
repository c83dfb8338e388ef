"""Trained operators: held-out accuracy, brute-force spans, odd cases, and the pipeline."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import pii, quality, toxicity

from .cases import documents, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, documents())


@pytest.fixture(scope="module")
def corpus():
    """Gibberish documents; the toxic ones hold insults of a small family, some with unseen endings."""
    r = random.Random(8)
    part = ["ka", "lo", "mi", "ne", "ru", "ta", "so", "vi", "de", "bu", "pa", "gi"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(1, 4)))
    insults = ["wretchik", "zornhead", "quaxling", "blorfo"]
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(r.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 4)):
                w.insert(r.randrange(len(w)), r.choice(insults) + r.choice(["", "", "en", "s", "a"]))
        good = i % 3 != 0
        text = " ".join(w) if good else " | ".join(x + "***" for x in w)
        rows.append((i, text, "en", f"s{i % 4}"))
        if i % 10 != 9:
            labels.append((i, int(good), int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark, corpus):
    rows, labels = corpus
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, truth):
    pairs = [(r["predicted"], truth[r["doc_id"]]) for r in out if held(r["doc_id"]) and r["doc_id"] in truth]
    return np.mean([p == t for p, t in pairs])


def test_toxicity_held_out(tables, corpus):
    out = toxicity.score(*tables).collect()
    assert len(out) == 500 and all(r["held_out"] == held(r["doc_id"]) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert accuracy(out, {i: t for i, _, t in corpus[1]}) >= 0.95
    clean = toxicity.remove_toxic(*tables)
    assert clean.columns == tables[0].columns and clean.count() == sum(r["predicted"] == 0 for r in out)


def test_toxicity_tolerates_gaps(corpus):
    labels = {i: t for i, _, t in corpus[1]}
    use = [(t, labels[i]) for i, t, _, _ in corpus[0] if i in labels]
    model = toxicity.fit([t for t, _ in use], [y for _, y in use])
    score = lambda t: float(model.score(*toxicity._joined([t]))[0])
    plain = score("kalo mine wretchik ruta zornhead sovi")
    assert plain > 0.5
    for said in ("kalo mine wret-chik ruta zorn*head sovi", "kalo mine wretxchik ruta zornyhead sovi", "kalo mine w r e t c h i k ruta z o r n h e a d sovi"):
        assert score(said) > 0.5, said
    assert score("kalo mine ruta sovi degi pabu") < 0.5


@pytest.fixture(scope="module")
def phrases():
    """Texts of twelve words; in toxic ones two of them, harmless apart, are neighbours."""
    r = random.Random(3)
    common = ["lump", "dirty", "kalo", "mine", "ruta", "sovi", "degi", "pabu", "tane", "viru", "bune", "somi"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(common) for _ in range(12)]
        at = r.randrange(11)
        toxic = i % 3 == 0
        for j in range(11):  # the pair only where it is meant
            if w[j : j + 2] == ["dirty", "lump"]:
                w[j] = "kalo"
        if toxic:
            w[at : at + 2] = ["dirty", "lump"]
        if w[at - 1 : at + 1] == ["dirty", "lump"] and not toxic:
            w[at] = "kalo"
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_sees_insults_of_two_words(spark, phrases):
    rows, labels = phrases
    out = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert accuracy(out, {i: t for i, _, t in labels}) >= 0.95
    model = toxicity.fit([t for _, t, _, _ in rows], [t for _, _, t in labels])
    score = lambda t: float(model.score(*toxicity._joined([t]))[0])
    for said in ("kalo mine dirty lump ruta sovi", "kalo mine d*i*rty lu-mp ruta sovi"):
        assert score(said) > 0.5, said
    for said in ("kalo lump mine dirty ruta sovi", "lump dirty kalo mine ruta"):
        assert score(said) < 0.5, said


def test_toxicity_pairs_have_the_sums_of_their_subsequences():
    """Sums over words and pairs, put together from crossing ones, against the features of each instance alone."""
    texts = ["you are an id-iot, a b c d clown", "", "one", "zz top it is"]
    words = toxicity.Words(*toxicity.stream(*toxicity._joined(texts)))
    keys = np.unique(np.concatenate([k for _, k in toxicity.subsequences(words.b, words.far)]))
    table = toxicity.Table(keys, np.cos(keys.astype(float)), 0.25)
    got = np.concatenate(table.margins(words))
    said = words.instances(np.arange(len(got)))
    assert said[:2] == [b" you ", b" are "] and b" an idiot " in said and b" clown one " not in said and b" one zz " not in said
    i, k, v = toxicity.word_features(said)
    want = np.bincount(i, weights=v * np.cos(k.astype(float)), minlength=len(said)) + 0.25
    assert np.abs(got - want).max() < 1e-5


def test_toxicity_odd_cases(docs, tables, spark):
    out = toxicity.score(docs, tables[1]).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), tables[1]).count() == 0


def test_toxicity_without_signal_marks_nothing():
    """Labels that the texts don't explain: no text may be marked by them, empty ones included."""
    text = "one and the same text of some plain words"
    for texts, labels in (([text, text], [1, 0]), ([text, text + " more"] * 8, [1, 0, 0, 1] * 4), ([text] * 9 + [""], [1] * 5 + [0] * 5)):
        model = toxicity.fit(texts, labels)
        assert model.score(*toxicity._joined([text, "", "other words here", *texts])).max() < 0.5


def test_fit_holds_little_beside_its_features():
    """9,000 short instances, and long ones of few distinct subsequences: the driver makes no rows for all of these at once."""
    r = random.Random(3)
    words = [b" " + "".join(r.choice("abcdef") for _ in range(r.randint(4, 12))).encode() + b" " for _ in range(9000)]
    long = b" " + b"abcdef" * 3000 + b" "
    words += [long] * 3
    machine = toxicity.Machine(words[:256])
    y = np.array([1.0 if b"ab" in w else -1.0 for w in words])
    tracemalloc.start()
    try:
        machine.fit(words, y, np.ones(len(words)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < len(words) * 256 * 8 + 50e6
    # the kernels of the long one are those of its subsequences, counted one by one
    _, keys, values = toxicity.word_features([long])
    plain = np.zeros(256)
    for k, v in zip(keys.tolist(), values.tolist(), strict=True):
        at = np.searchsorted(machine.keys, k)
        if at < len(machine.keys) and machine.keys[at] == k:
            plain += v * machine.phi[at]
    assert np.allclose(machine.features([words[0], long, words[1]])[1], plain @ machine.root)


def test_kernel_is_the_subsequence_kernel():
    """The explicit features give the gap-weighted kernel of two words, by brute force."""
    from itertools import combinations

    def features(w):
        out = {}
        for at in combinations(range(len(w)), toxicity.TUPLE):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN:
                key = bytes(w[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (span - toxicity.TUPLE)
        return out

    words = [b" idiot ", b" id-iot "[:3] + b"xiot ", b" scum "]
    i, k, v = toxicity.word_features(words)
    norm = toxicity.norms(np.array([len(w) - 1 for w in words]))
    for n, w in enumerate(words):
        want = features(w)
        got = {}
        for key, value in zip(k[i == n].tolist(), (v * norm[i])[i == n].tolist(), strict=True):
            b = key.to_bytes(4, "little")
            got[b] = got.get(b, 0) + value
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_quality_held_out(tables, corpus):
    out = quality.score(*tables).collect()
    assert accuracy(out, {i: q for i, q, _ in corpus[1]}) >= 0.95


def test_quality_metadata_alone_carries_a_label():
    """A label that only the source tells is learned through the metadata view."""
    r = random.Random(2)
    rows = [(" ".join(r.choice(["aa", "bb", "cc"]) for _ in range(20)), f"s{i % 2}", "en", 60) for i in range(200)]
    y = np.array([i % 2 for i in range(200)], dtype=float)
    m = quality.fit(quality.views_of(rows[:150]), y[:150], quality.views_of(rows[150:]))
    assert ((m.score(quality.views_of(rows[150:])) >= 0.5) == y[150:]).mean() == 1.0


def test_quality_odd_cases(docs, tables, spark):
    out = quality.score(docs, tables[1]).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


# -- personal data ------------------------------------------------------------

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
)
TEXTS = [
    "mail a.b+c@x-y.example.com, x@y, @z.com, a@b.c@d.e.f and q@@r.s",
    "漢🙂 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3 999.9.9.9.9.9.9",
    "4111 1111 1111 1111 and 4111111111111112 and 4111-1111-1111-1111-0 and 5500 0000 0000 0004 7",
    "+1 (980) 555-6268, +49 30 1234567 8901234567, +12, ++1 234 567 89, +1 2 3 4 5 6 7 8.",
    "call 555-123-4567 or (504) 555-2652; write john at example dot com, or jane [at] example [dot] org",
    "9" * 5000 + " " + "a" * 3000 + "@" + "b" * 10 + ".c",
    "", None, "no data at all",
]


def test_pii_base_spans():
    for t in TEXTS:
        t = t or ""
        want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == want, t[:60]


def test_pii_random_texts_match_the_patterns():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("01259.@+- ()ab%_,\n") for _ in range(r.randint(0, 60)))
        want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == want, t


def test_pii_query(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"phone: +1 (980) 555-{1000 + i} mail me at m{i}@example.com", "en", "a") for i in range(40)]
    out = {r["doc_id"]: r for r in pii.find(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, t, _, _ in rows:
        base = [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t or "")]
        r = out[i]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(k, int(s), int(e)) for k, s, e in spans} >= set(base)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
    assert any(x.startswith("phone") for x in out[4]["spans"].split(","))
    assert pii.find(frame(spark, [])).count() == 0


def test_expectation_maximisation_finds_reliable_labellers():
    r = random.Random(6)
    counts = {}
    for _ in range(4000):
        truth = r.random() < 0.5
        vote = lambda p, t=truth: ("+" if t else "-") if r.random() < p else ("-" if t else "+")
        p = vote(0.95) + vote(0.9) + vote(0.6) + vote(0.6) + vote(0.9) + "00"
        counts[p] = counts.get(p, 0) + 1
    m = pii.SpanModel([(3, p, n) for p, n in counts.items()])
    right = [m.reliability[j, 1, 2] for j in range(pii.LABELLERS)]
    assert right[0] > 0.85 and right[1] > 0.8 and right[2] < 0.75


# -- pipeline -----------------------------------------------------------------


def test_pipeline(spark, tables, corpus, tmp_path):
    rows, _ = corpus
    items = [(1, " ".join(rows[3][1].split()[:13])), (2, "not there at all")]
    tables[0].write.parquet(str(tmp_path / "documents.parquet"))
    tables[1].write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = tables[0], tables[0].columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"out-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "sharding":
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] < 500 and sizes[2] == sizes[1] - 1 and sizes[4] == sizes[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
