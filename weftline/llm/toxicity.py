r"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two instances counts the subsequences of four characters (UTF-8
bytes, spaces included) that they share, each weighted by a decay per skipped
character, with at most two skipped: so a gapped or padded insult stays close to
the plain one.  Instances are the words of a text and the pairs of neighbouring
words, whose subsequences cross from one word into the next: so an insult of two
words is seen though either word alone is harmless.  Characters other than
letters and digits inside a word are dropped, and letters that stand alone
("i d i o t") are joined first.

Labels belong to whole texts, of which words and pairs inherit them only in
part, so the machine is trained as a multiple-instance one: instances start with
a prior from the counts of their subsequences; the SVM is fitted on the
likeliest instances of toxic texts against the likeliest and some other ones of
clean texts; instances are chosen anew with the machine's own margins, for a few
rounds.  Nystroem landmarks are instances; features are kernels to the landmarks
times the inverse root of their own kernel matrix.

For scoring, the machine folds into one weight per subsequence of a landmark:
the kernel expansion is linear in subsequences.  A word costs a few table
lookups per character, and a pair only those that cross.  A document's score is
a logistic calibration of its strongest words and pairs and of the mass of
positive ones.

Bounds: the fit uses at most MAX_TOXIC toxic and MAX_CLEAN clean labelled rows
of at most MAX_TEXT bytes each, taken by hash of their id.  Counting, choosing
and margins run in tasks; the driver solves for the machine on the chosen
instances.  Every whole text is scored.

Defined cases: null and empty texts score like a text without any marked word;
contradictory labels of one document count as toxic; no usable labels, or a fit
that can't tell its toxic texts from its clean ones, give score 0 throughout;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, text_buffer
from .linear import apply, fit_logistic, fit_svm, sigmoid
from .shared import materialize, text_column

MAX_TOXIC, MAX_CLEAN = 1500, 2000
#: Bytes of a text in the fit; longer ones are scored, but not learned from.
MAX_TEXT = 32_768
#: Characters of a subsequence, and the span that it may take in a word.
TUPLE, SPAN = 4, 6
DECAY = 0.7
#: Tasks of the fit, and bytes of texts that a task takes at once; a longer text is a piece of its own.
TASKS, PIECE = 16, 1 << 18
LANDMARKS = 256
#: Bytes of instances, and subsequences of them, that the features of the fit are made from at once.
BLOCK, HITS = 1 << 14, 1 << 12
ROUNDS = 3
#: Of a clean document's instances, the HARD strongest and every OTHER-th of the rest are trained on.
HARD, OTHER = 3, 256
#: Mean score by which the toxic texts of the fit must be above its clean ones; else there is nothing to mark by.
LEAST_SIGNAL = 0.1
#: One label row in FOLDS is held out.
FOLDS = 5

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), TUPLE - 1)]
_WEIGHTS = np.array([DECAY ** (p[-1] + 1 - TUPLE) for p in _PATTERNS], dtype=np.float32)

_fold = np.zeros(256, dtype=np.uint8)  # 0: dropped
_fold[0x30:0x3A] = np.arange(0x30, 0x3A)
_fold[0x61:0x7B] = np.arange(0x61, 0x7B)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
_fold[0x80:] = np.arange(0x80, 0x100)
_fold[[0x20, *range(0x09, 0x0E)]] = 0x20


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with one space around every word; where words begin (at their space); the words' documents."""
    b = _fold[data]
    # a document ends with a space of its own
    b = np.insert(b, offsets[1:], 0x20)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets) + 1)
    keep = b != 0
    b, doc = b[keep], doc[keep]
    space = b == 0x20
    # letters that stand alone, three or more in a row, are one word
    alone = ~space
    alone[1:] &= space[:-1]
    alone[:-1] &= space[1:]
    at = np.flatnonzero(alone)
    if len(at) > 2:
        near = (np.diff(at) == 2) & (doc[at[1:]] == doc[at[:-1]])
        run = np.zeros(len(near), dtype=bool)
        run[:-1] |= near[:-1] & near[1:]
        run[1:] |= near[1:] & near[:-1]
        gone = np.zeros(len(b), dtype=bool)
        gone[at[:-1][run] + 1] = True
        b, doc, space = b[~gone], doc[~gone], space[~gone]
    twice = space.copy()
    twice[1:] &= space[:-1]
    if len(twice):
        twice[0] = space[0]
    b, doc, space = b[~twice], doc[~twice], space[~twice]
    b = np.r_[np.uint8(0x20), b]
    ends = np.flatnonzero(b == 0x20)
    begin = ends[:-1]
    return b, begin, doc[begin] if len(begin) else np.zeros(0, dtype=np.int32)


def subsequences(b: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pattern, a mask of the positions whose ``room`` (steps to the end of their instance) it fits, and its four bytes as a key."""
    n = len(room)
    wide = np.zeros(max(n, len(b)) + SPAN, dtype=np.uint32)
    wide[: len(b)] = b
    shifted = [wide << np.uint32(8 * k) for k in range(TUPLE)]
    for p in _PATTERNS:
        keys = shifted[0][:n] | shifted[1][p[1] : n + p[1]] | shifted[2][p[2] : n + p[2]] | shifted[3][p[3] : n + p[3]]
        yield room >= p[-1], keys


class Words:
    """The words of a stream and the pairs of neighbours in one document; both are instances.

    A pair's subsequences are those of its two words and those that cross
    between them, so sums over pairs need the crossing ones only.
    """

    def __init__(self, b: np.ndarray, begin: np.ndarray, doc: np.ndarray):
        self.b, self.begin, self.doc = b, begin, doc
        end = np.r_[begin[1:], len(b) - 1] if len(begin) else begin
        self.end, self.length = end, end - begin
        self.first = np.flatnonzero(doc[1:] == doc[:-1])  # first words of pairs
        far = end.copy()
        far[self.first] = end[self.first + 1]
        self.word_of = np.repeat(np.arange(len(begin), dtype=np.int32), self.length)
        at = np.arange(len(self.word_of), dtype=np.int32)
        self.near, self.far = end.astype(np.int32)[self.word_of] - at, far.astype(np.int32)[self.word_of] - at
        self.docs = np.r_[doc, doc[self.first]]

    def sums(self, weigh) -> tuple[np.ndarray, np.ndarray]:
        """Sums over words and over pairs; ``weigh(valid, keys)`` gives positions and their weights."""
        n = len(self.begin)
        word, cross = np.zeros(n), np.zeros(n)
        for (valid, keys), w, p in zip(subsequences(self.b, self.far), _WEIGHTS, _PATTERNS, strict=True):
            i, v = weigh(valid, keys)
            at, v, inside = self.word_of[i], w * v, self.near[i] >= p[-1]
            word += np.bincount(at[inside], weights=v[inside], minlength=n)
            cross += np.bincount(at[~inside], weights=v[~inside], minlength=n)
        return word, word[self.first] + cross[self.first] + word[self.first + 1]

    def norms(self) -> tuple[np.ndarray, np.ndarray]:
        pair = self.length[self.first] + self.length[self.first + 1]
        by_length = norms(np.arange(max(self.length.max(initial=0), pair.max(initial=0)) + 1))
        return by_length[self.length], by_length[pair]

    def instances(self, which: np.ndarray) -> list[bytes]:
        """Words, then pairs, with the spaces around them."""
        raw, n = self.b.tobytes(), len(self.begin)
        at = np.where(which < n, which, 0)
        at[which >= n] = self.first[which[which >= n] - n]
        last = np.where(which < n, at, at + 1)
        return [raw[lo : hi + 1] for lo, hi in zip(self.begin[at].tolist(), self.end[last].tolist(), strict=True)]


def norms(length: np.ndarray) -> np.ndarray:
    """Root of the kernel of an instance with itself, repeated subsequences aside."""
    n = length + 1  # both boundaries count
    total = np.zeros(len(n))
    for p, w in zip(_PATTERNS, _WEIGHTS, strict=True):
        total += np.maximum(n - p[-1], 0) * float(w) ** 2
    return np.sqrt(np.maximum(total, 1e-9))


_BITS = 20


def _bin(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


class Prior:
    """A first margin: the mean weight of an instance's subsequences, weights by bin of the key."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray):
        self.weights = np.zeros(1 << _BITS, dtype=np.float32)
        self.weights[bins] = weights

    def margins(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        def weigh(valid, keys):
            v = self.weights[_bin(keys)]
            i = np.flatnonzero(valid & (v > 0))
            return i, v[i]

        return tuple(s / n**2 for s, n in zip(words.sums(weigh), words.norms(), strict=True))


class Table:
    """The machine, as weights by key in a table that is addressed by a hash of the key."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights.astype(np.float32), bias
        # of the keys that share a slot one is in it; the others are looked for in the sorted keys
        self.slots = np.full(1 << _BITS, -1, dtype=np.int32)
        self.slots[_bin(keys)] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(_bin(keys), minlength=1 << _BITS) > 1

    def margins(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        def weigh(valid, keys):
            bins = _bin(keys)
            i = self.slots[bins]
            some = np.flatnonzero((i >= 0) & valid)
            k, i = keys[some], i[some]
            hit = self.keys[i] == k
            again = np.flatnonzero(~hit & self.shared[bins[some]])
            if len(again):
                i[again] = np.minimum(np.searchsorted(self.keys, k[again]), len(self.keys) - 1)
                hit[again] = self.keys[i[again]] == k[again]
            return some[hit], self.weights[i[hit]]

        return tuple(s / n + self.bias for s, n in zip(words.sums(weigh), words.norms(), strict=True))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, key, value) of normalised subsequence counts; words or pairs carry their spaces."""
    b = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words], dtype=np.int64)
    word_of = np.repeat(np.arange(len(words)), size)
    room = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(b))
    norm = norms(size - 1)
    i, k, v = [], [], []
    for (valid, keys), w in zip(subsequences(b, room), _WEIGHTS, strict=True):
        at = np.flatnonzero(valid)
        i.append(word_of[at])
        k.append(keys[at])
        v.append(np.full(len(at), w))
    i, k, v = np.concatenate(i), np.concatenate(k), np.concatenate(v)
    return i, k, v / norm[i]


class Machine:
    """Nystroem features over landmarks and the SVM in their space."""

    def __init__(self, landmarks: list[bytes]):
        i, k, v = word_features(landmarks)
        self.keys, col = np.unique(k, return_inverse=True)
        self.phi = np.zeros((len(self.keys), len(landmarks)))
        np.add.at(self.phi, (col, i), v)
        values, vectors = np.linalg.eigh(self.phi.T @ self.phi)
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def features(self, words: list[bytes]) -> np.ndarray:
        """Kernels to the landmarks times the inverse root; beside the result a few MB, however long an instance is."""
        out = np.empty((len(words), self.root.shape[1]))
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        lo = 0
        while lo < len(words):
            before = end[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + 500, int(np.searchsorted(end, before + BLOCK, side="right"))))
            i, k, v = word_features(words[lo:hi])
            at = np.searchsorted(self.keys, k)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == k)
            hit = hit[np.argsort(i[hit], kind="stable")]
            kernels = np.zeros((hi - lo, self.phi.shape[1]))
            for some in range(0, len(hit), HITS):
                h = hit[some : some + HITS]
                rows = self.phi[at[h]]
                rows *= v[h][:, None]
                start = np.flatnonzero(np.r_[True, i[h][1:] != i[h][:-1]])
                kernels[i[h][start]] += np.add.reduceat(rows, start, axis=0)
            out[lo:hi] = kernels @ self.root
            lo = hi
        return out

    def fit(self, words: list[bytes], y: np.ndarray, weight: np.ndarray) -> Table:
        w = fit_svm(self.features(words), y, 1.0, weight)
        return Table(self.keys, self.phi @ (self.root @ w[:-1]), float(w[-1]))


def _top(doc: np.ndarray, margin: np.ndarray, n: int, out: np.ndarray) -> None:
    """Per document, into three columns of ``out``: strongest margin, log mass of positive margins, log of their share."""
    out[:, 0] = -2.0
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        d = doc[first]
        out[d, 0] = np.maximum.reduceat(margin, first)
        mass = np.add.reduceat(np.maximum(margin, 0), first)
        out[d, 1] = np.log1p(mass)
        out[d, 2] = np.log1p(100 * mass / np.diff(np.r_[first, len(doc)]))


def summary(words: Words, word: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    """Per document: strongest margin, mass and share of words; the same of pairs; second strongest word."""
    out = np.zeros((n, 7))
    _top(words.doc, word, n, out[:, :3])
    _top(words.doc[words.first], pair, n, out[:, 3:6])
    out[:, 6] = -2.0
    if len(word):
        order = np.lexsort((word, words.doc))
        d = words.doc[order]
        second = order[:-1][(d[1:] == d[:-1]) & np.r_[d[2:] != d[1:-1], True]]
        out[words.doc[second], 6] = word[second]
    return np.clip(out, -2, 6)


class Model:
    def __init__(self, table: Table | None, weights: np.ndarray | None = None):
        self.table, self.weights = table, weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.table is None:
            return np.zeros(n)
        words = Words(*stream(data, offsets))
        return sigmoid(apply(self.weights, summary(words, *self.table.margins(words), n)))


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


# -- the steps of the fit that read texts; each runs on pieces of the labelled rows --


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def count_bins(words: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of subsequences, with the toxic and all documents that hold them."""
    doc = words.doc[words.word_of].astype(np.int64) << _BITS
    pairs = _distinct(np.concatenate([_distinct(_bin(k[valid]) | doc[valid]) for valid, k in subsequences(words.b, words.far)]))
    bins = pairs & ((1 << _BITS) - 1)
    toxic, every = np.bincount(bins, weights=y[pairs >> _BITS], minlength=1 << _BITS), np.bincount(bins, minlength=1 << _BITS)
    some = np.flatnonzero(every)
    return some, toxic[some], every[some]


def choose(words: Words, scorer, y: np.ndarray, first: bool) -> tuple[list[int], list[bytes]]:
    """Labels and instances to train on: of toxic documents the strongest, of clean ones the strongest and some others."""
    margin = np.concatenate(scorer.margins(words))
    order = np.lexsort((-margin, words.docs))
    d = words.docs[order]
    start = np.r_[True, d[1:] != d[:-1]]
    rank = np.arange(len(d)) - np.maximum.accumulate(np.where(start, np.arange(len(d)), 0))
    toxic = y[d] == 1
    positive = order[toxic & ((rank < 2) if first else ((rank < 1) | ((rank < 8) & (margin[order] > 0))))]
    # the others are every OTHER-th by their place
    negative = order[~toxic & ((rank < HARD) | ((rank - HARD) % OTHER == 0))]
    return [1] * len(positive) + [0] * len(negative), words.instances(np.r_[positive, negative])


def weigh_bins(toxic: np.ndarray, every: np.ndarray, rate: float) -> np.ndarray:
    """Signed root of the G statistic; small ones are 0."""
    p = np.clip(toxic / np.maximum(every, 1), 1e-9, 1 - 1e-9)
    g = 2 * every * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))
    z = np.sign(p - rate) * np.sqrt(np.maximum(g, 0))
    z[z < 2.5] = 0
    return z


def train(rate: float, counts, chosen, summaries) -> Model:
    """The rounds.  ``counts()``: bins and their counts; ``chosen(scorer, first)``: label, instance and number of each; ``summaries(scorer)``: x and y of the documents."""
    bins, toxic, every = counts()
    scorer = Prior(bins, weigh_bins(toxic, every, rate))
    for r in range(ROUNDS):
        found = sorted(chosen(scorer, r == 0))
        said = [w for _, w, _ in found]
        target = np.array([1.0 if y else -1.0 for y, _, _ in found])
        many = np.array([n for _, _, n in found], dtype=float)
        if not len(found) or target.min() == target.max():
            return Model(None)
        common = sorted((f for f in found if f[0] == 1), key=lambda f: (-f[2], f[1]))
        marks = [w for _, w, _ in common[: LANDMARKS * 3 // 4]]
        known = {w for _, w, _ in common}
        rest = sorted((f for f in found if f[0] == 0 and f[1] not in known), key=lambda f: (-f[2], f[1]))
        marks += [w for _, w, _ in rest[: LANDMARKS - len(marks)]]
        # both classes weigh the same
        weight = many * np.where(target > 0, 0.5 / many[target > 0].sum(), 0.5 / many[target < 0].sum()) * many.sum()
        scorer = Machine(marks).fit(said, target, weight)
    x, y = summaries(scorer)
    weights = fit_logistic(x, y.astype(float), 1.0)
    said = sigmoid(apply(weights, x))
    if said[y == 1].mean() - said[y == 0].mean() < LEAST_SIGNAL:
        return Model(None)
    return Model(scorer, weights)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """The fit on rows at hand."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None)
    words = Words(*stream(*_joined(texts)))
    if not len(words.begin):
        return Model(None)

    def chosen(scorer, first):
        return [(label, word, n) for (label, word), n in Counter(zip(*choose(words, scorer, y, first), strict=True)).items()]

    return train(float(y.mean()), lambda: count_bins(words, y), chosen, lambda s: (summary(words, *s.margins(words), len(y)), y))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """At most ``most[c]`` labelled documents of each class (label and the columns of ``docs``), by hash of the id, outside of the held-out fold.

    No text over MAX_TEXT bytes; of rows that repeat an id the least one.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    docs = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TEXT)
    usable = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    ids = None
    for c, limit in most.items():
        some = usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        ids = some if ids is None else ids.unionAll(some)
    found = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*rest)).alias("r"))
    return found.select("doc_id", "label", "r.*")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> list:
    """The rows of ``training_sample`` on the driver."""
    return training_sample(docs, labels, label, most).orderBy(F.desc("label"), F.xxhash64("doc_id"), "doc_id").collect()


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """Words and labels of the rows (label, text) of a task, in pieces."""
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in chunks(offsets, PIECE):
            yield Words(*stream(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])), y[lo:hi]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, y in _pieces(batches):
        if len(words.begin):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in count_bins(words, y)], names=["bin", "toxic", "every"])


def _chosen(scorer, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, y in _pieces(batches):
            if len(words.begin):
                label, instance = choose(words, scorer.value, y, first)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(instance, pa.binary())], names=["label", "instance"])

    return run


def _summaries(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, y in _pieces(batches):
            x = summary(words, *scorer.value.margins(words), len(y))
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def fit_model(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Texts stay in the tasks; the driver gets counts per bin, the chosen instances and a summary of each labelled document."""
    context = docs.sparkSession.sparkContext
    rows = training_sample(docs.select("doc_id", "text"), labels, "toxic", {1: max_toxic, 0: max_clean})
    rows = materialize(rows.select("label", "text").repartition(TASKS), "toxicity-sample")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).head()
    if toxic in (0, n):
        return Model(None)

    def counts():
        t = rows.mapInArrow(_count, "bin long, toxic long, every long").groupBy("bin").agg(F.sum("toxic"), F.sum("every")).toArrow()
        return tuple(c.to_numpy() for c in t.columns)

    def chosen(scorer, first):
        found = rows.mapInArrow(_chosen(context.broadcast(scorer), first), "label int, instance binary")
        return [(r[0], bytes(r[1]), r[2]) for r in found.groupBy("label", "instance").count().collect()]

    def summaries(scorer):
        found = rows.mapInArrow(_summaries(context.broadcast(scorer)), "label int, x array<double>").orderBy("x", "label").collect()
        return np.array([r[1] for r in found]), np.array([r[0] for r in found])

    return train(toxic / n, counts, chosen, summaries)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            score = np.zeros(batch.num_rows)
            for lo, hi in chunks(offsets, PIECE):
                score[lo:hi] = model.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, max_toxic, max_clean))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), SCHEMA)


def _keep(model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in chunks(offsets, PIECE):
                keep[lo:hi] = model.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) < 0.5
            yield batch.filter(pa.array(keep))

    return run


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels))
    return docs.mapInArrow(_keep(model, text_column(docs)), docs.schema)
