"""Operators with an exact contract against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import decontamination, exact_dedup, mixing, near_dedup, sharding, sparse_windows, substring_dedup, suffix_dedup
from weftline.llm.kernels import multikey_quicksort

from .cases import by_id, documents, frame

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- exact dedup --------------------------------------------------------------


def test_exact_dedup(docs, rows, spark):
    key = lambda t: SPACE.sub("", t or "")
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[key(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t, _, _ in rows:
        g = groups[key(t)]
        best = min(g)
        kept = i == best[3] and len(t or "") == -best[0]
        want.append((i, best[3], len(g), kept, hashlib.sha256(key(t).encode()).hexdigest()))
    got = by_id(exact_dedup.decisions(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)


def test_exact_dedup_keeps_one_row_per_text_and_remembers(docs, rows, spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.deduplicate(docs, index)
    assert first.columns == docs.columns
    assert first.count() == len({SPACE.sub("", t or "") for _, t, _, _ in rows})
    assert exact_dedup.deduplicate(docs, index).count() == 0
    plan = index.read().join(spark.range(1).selectExpr("cast(id as string) digest").hint("merge"), "digest", "left_anti")
    assert plan.count() == first.count()
    new = frame(spark, [(900, "never seen before", "en", "a"), (901, "never  seen before", "en", "a")])
    assert [r["doc_id"] for r in exact_dedup.deduplicate(new, index).collect()] == [901]


# -- mixing -------------------------------------------------------------------


def test_mixing_targets_and_draw(docs, rows):
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    full = {s: int(target[s] // size[s]) if size[s] else 0 for s in names}
    assert all(r["copies"] in (full[r["source"]], full[r["source"]] + 1) for r in out)


def test_mixing_reruns_agree_and_expand(docs, empty):
    a, b = (by_id(mixing.mix_report(docs.repartition(n)), "doc_id", "source", "taken") for n in (1, 7))
    assert a == b
    mixed = mixing.expand(mixing.mix(docs), docs.columns)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix_report(docs).collect())
    assert mixing.mix_report(empty).count() == 0


def test_mixing_many_buckets(docs, monkeypatch):
    one = by_id(mixing.mix_report(docs), "doc_id", "source", "taken")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert by_id(mixing.mix_report(docs), "doc_id", "source", "taken") == one


# -- near dedup ---------------------------------------------------------------


def near_brute(rows):
    sets = []
    for i, t, _, _ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    full = {}
    for i, s in sets:
        if i is not None:
            full[i] = (i, len(s), root(i), root(i) == i)
    return full


def test_near_dedup(docs, rows, empty):
    want = near_brute(rows)
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert len(got) == len(rows)
    for g in got:
        if g[0] is None:
            assert g[2] == 1 and not g[3]  # a copy of the first document
        else:
            assert g == want[g[0]]
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, w in want.items() if w[3]}


def test_near_dedup_chain(spark):
    """Links that only later members of a bucket have: a long chain, each like the next alone."""
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(25):
        w = list(base)
        for k in range(i):
            w[(k * 13) % 300] = f"x{k}"
        rows.append((i + 1, " ".join(w), "en", "a"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: w[2] for i, w in near_brute(rows).items()}


def test_odd_sketch_tells_similarities():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 2000, dtype=np.uint64))
    limit = near_dedup.most_differing_bits(85)
    for share, near in ((0.93, True), (0.86, True), (0.6, False), (0.3, False)):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.r_[a[:k], r.integers(0, 2**63, len(a) - k, dtype=np.uint64)])
        _, _, s, _ = near_dedup.signatures(np.r_[a, b], np.array([0, len(a)]))
        z = sum(int(x).bit_count() for x in (s[0] ^ s[1]).view(np.uint64))
        assert (z <= limit) is near


# -- decontamination ----------------------------------------------------------


def decon_brute(rows, items, length=13):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = tok(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    for i, t, _, _ in rows:
        w, hit, ids = tok(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        yield (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(docs, rows, spark, block):
    passage = rows[9][1].split()
    items = [(10, " ".join(passage[25:55])), (9, "Very; SAME"), (9, "Very; SAME"), (None, "z" * 450), (4, None), (5, "  "), (6, " ".join(passage[40:52])), (7, "漢🙂")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(docs, bench, block_bytes=block)
    got = by_id(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(decon_brute(rows, items), key=repr)
    kept = decontamination.remove_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in decon_brute(rows, items))


def test_decontamination_empty(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontamination.contamination(empty, none).count() == 0


# -- sharding -----------------------------------------------------------------


def check_shards(out, rows, shards=16):
    assert len(out) == len(rows)
    slots, load, of = defaultdict(list), Counter(), defaultdict(set)
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(t or "")
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        for t in texts[r["doc_id"]]:
            of[t].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    return load


def test_sharding(docs, rows, empty):
    out = sharding.shard(docs).collect()
    load = check_shards(out, rows)
    assert sum(load.values()) == sum(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    assert sharding.shard(empty).count() == 0


def test_sharding_levels_and_balance(spark, monkeypatch):
    """More groups than a block holds: the partial partitions are combined level by level."""
    monkeypatch.setattr(sharding, "BLOCK", 16)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(i, f"t{i} " + "x" * (i * 37 % 500), "en", "a") for i in range(1500)] + [(2000 + i, "same", "en", "a") for i in range(60)]
    load = check_shards(sharding.shard(frame(spark, rows)).collect(), rows)
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.01 * max(load.values())


def test_differencing_beats_round_robin():
    r = np.random.default_rng(5)
    sizes = np.sort(r.integers(1, 100_000, 300))[::-1]
    to = sharding.difference(sharding._single(sizes, 16), 16)[:, 0]
    load = np.bincount(to, weights=sizes, minlength=16)
    robin = np.bincount(np.arange(300) % 16, weights=sizes, minlength=16)
    assert np.ptp(load) < 0.05 * np.ptp(robin)


# -- suffix array and substring dedup -------------------------------------------


def suffix_brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t, _, _ in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        yield (i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup(docs, rows, empty):
    got = by_id(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(suffix_brute(rows), key=repr)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def substring_brute(rows, length=13):
    last = 2**63 - 1
    data = [(i, last if i is None else i, words(t)) for i, t, _, _ in rows]
    first = {}
    for _, o, w in data:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, last), o)
    for i, o, w in data:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < o:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup(docs, rows, empty):
    assert by_id(substring_dedup.remove_known(docs), *COLUMNS) == sorted(substring_brute(rows), key=repr)
    assert substring_dedup.remove_known(empty).count() == 0


def test_substring_index_over_batches(spark, rows):
    """Three batches against the index give what one pass gives; compaction changes nothing."""
    rows = [r for r in rows[:-2] if r[0] is not None]
    index = substring_dedup.FingerprintIndex(spark, 8)
    got, past = [], None
    for part in (rows[:20], rows[20:45], rows[45:]):
        batch = frame(spark, part)
        got += by_id(substring_dedup.remove_known(batch, index, past), *COLUMNS)
        past = batch if past is None else past.unionByName(batch)
        index.compact()
        assert len(index.runs) == 1
    assert sorted(got, key=repr) == sorted(substring_brute(rows), key=repr)
    index.vacuum()


@pytest.mark.parametrize("units,length,gram,policy", [("bytes", 200, 96, "anywhere"), ("words", 13, 5, "earlier")])
def test_wide_leads_take_the_exact_way(docs, rows, units, length, gram, policy):
    """Runs of wide leads are compared window by window, with the same result."""
    spec = sparse_windows.Spec(units, length, gram, policy)
    r = {
        "lead": np.array([5, 5, 5, 9], dtype=np.uint64), "ctx": np.array([1, 2, 2, 3], dtype=np.uint64), "key": np.arange(4), "ord": np.arange(4),
        "start": np.zeros(4, dtype=np.int64), "n": np.ones(4, dtype=np.int32), "flags": np.zeros(4, dtype=np.uint8),
    }
    out, kind, wide = sparse_windows.settle(r, policy)
    assert not wide.any() and len(kind) == 3
    keyed = sparse_windows.keyed(docs)
    if units == "bytes":
        cut = suffix_dedup.splitters(keyed, spec, 4)
        assert len(cut) == 3 and (np.diff(cut.astype(object)) >= 0).all()
        payload = keyed.select("key", "ord", "text").mapInArrow(sparse_windows._records(spec, 4, sparse_windows.by_lead(4)), sparse_windows.PAYLOAD)
        runs = sparse_windows.exchange(payload, 4).mapInArrow(sparse_windows._compare(policy), sparse_windows.RUNS)
        import pyspark.sql.functions as F

        runs = runs.withColumn("lead", F.lit(None).cast("long")).cache()
        rest = sparse_windows.with_spans(keyed, sparse_windows.repeated_runs(keyed, runs, spec, 4), spec)
        got = by_id(rest.mapInArrow(suffix_dedup._cut, suffix_dedup.SCHEMA), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(suffix_brute(rows), key=repr)


def test_multikey_quicksort_is_a_stable_order():
    rng = np.random.default_rng(3)
    for n, most in ((0, 5), (1, 5), (9000, 1), (9000, 3), (20000, 2**63)):
        a, b, c = (rng.integers(0, most, n, dtype=np.uint64) for _ in range(3))
        assert (multikey_quicksort(a, b, c) == np.lexsort((c, b, a))).all()
        assert (multikey_quicksort(a) == np.argsort(a, kind="stable")).all()
