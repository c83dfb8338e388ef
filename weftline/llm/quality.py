"""Quality classifier by co-training of a content view and a metadata view.

The content view sees hashed words and hashed word shapes (letters folded to
classes, repeats collapsed) of the text.  The metadata view sees the page's
source, language, length and layout (lines, characters per line), never the
words.  Each view is a logistic model.  Over rounds each view labels the
unlabelled rows of which it is surest, in the classes' own shares, and hands
them to the other view.  Each view's margin is calibrated by cross-validation
on the labelled rows, and a last logistic model over both calibrated margins
scores all documents: a view without signal gets no weight.

Bounds: the fit uses at most MAX_PER_CLASS labelled rows of each class and
MAX_UNLABELLED rows without a label, taken by hash of their id.  Every whole
text is scored.

Defined cases: null and empty texts have no words; null source or language is a
value of its own; a missing n_chars is taken from the text; contradictory labels
of one document count as good; without labels of both classes the score is the
share of good labels, or 0.5; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, U64, chunks, text_buffer, word_hashes
from .linear import apply, fit_logistic, sigmoid
from .toxicity import FOLDS, held_out, training_rows

MAX_PER_CLASS, MAX_UNLABELLED = 1500, 2000
WORDS, SHAPES = 256, 256
SOURCES, LANGS = 64, 16
ROUNDS = 4
#: Share of the unlabelled rows that one view labels in a round.
SHARE = 0.05

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_shape = np.arange(256, dtype=np.uint8)
_shape[0x61:0x7B] = ord("a")
_shape[0x80:] = ord("a")
_shape[0x41:0x5B] = ord("A")
_shape[0x30:0x3A] = ord("0")
_shape[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20


def _bag(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool) -> np.ndarray:
    """Square roots of relative counts of hashed words; for words as they are, how repetitive they are."""
    n = len(offsets) - 1
    _, _, hashes, first = word_hashes(data, offsets, NOT_SPACE, lower)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    if lower:
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[fresh], minlength=n) / np.maximum(words, 1)
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[again], minlength=n) / np.maximum(words, 1)
        extra = np.c_[distinct, distinct**4, np.minimum(again * 5, 1), np.sqrt(again)]
    counts = np.bincount(doc * size + (hashes % U64(size)).astype(np.int64), minlength=n * size).reshape(n, size)
    out = np.sqrt(counts / np.maximum(words, 1)[:, None])
    return np.hstack([out, extra]) if lower else out


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    shape = _shape[data]
    fresh = np.ones(len(shape), dtype=bool)
    fresh[1:] = shape[1:] != shape[:-1]
    inner = offsets[(offsets < len(shape))]
    fresh[inner] = True
    at = np.r_[0, np.cumsum(fresh)][offsets]
    return np.hstack([_bag(data, offsets, WORDS, True), _bag(shape[fresh], at, SHAPES, False)])


def _hashed(values: list, size: int) -> np.ndarray:
    out = np.zeros((len(values), size))
    for i, v in enumerate(values):
        out[i, zlib.crc32(repr(v).encode()) % size] = 1
    return out


def metadata(source: list, lang: list, n_chars: list, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    lines = np.r_[0, np.cumsum(data == 0x0A)]
    lines = lines[offsets[1:]] - lines[offsets[:-1]] + 1
    chars = np.array([float(s) if c is None else float(c) for c, s in zip(n_chars, size.tolist(), strict=True)])
    layout = np.c_[np.log1p(np.maximum(chars, 0)), np.log(lines), np.log1p(np.maximum(chars, 0) / lines)] / 5
    return np.hstack([_hashed(source, SOURCES), _hashed(lang, LANGS), layout])


class Model:
    """Both views, their calibrations and the combination."""

    def __init__(self, base: float = 0.5):
        self.base, self.views, self.calibration, self.last = base, None, None, None

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if self.views is None:
            return np.full(len(views[0]), self.base)
        z = [apply(c, apply(w, x)[:, None]) for w, c, x in zip(self.views, self.calibration, views, strict=True)]
        return sigmoid(apply(self.last, np.clip(np.c_[z[0], z[1]], -8, 8)))


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    # classes weigh the same
    good = (weight * y).sum()
    total = weight.sum()
    balance = np.where(y > 0.5, 0.5 * total / max(good, 1e-9), 0.5 * total / max(total - good, 1e-9))
    return fit_logistic(x, y, 0.3, weight * balance, 12)


def fit(labelled: tuple, y: np.ndarray, unlabelled: tuple, seed: int = 5) -> Model:
    """labelled, unlabelled: (content, metadata) matrices."""
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    model = Model()
    n, m = len(y), len(unlabelled[0])
    rate = y.mean()
    taken = [np.zeros(m), np.zeros(m)]  # what each view was told: weight
    told = [np.zeros(m), np.zeros(m)]
    weights = [_train(x, y, np.ones(n)) for x in labelled]
    for _ in range(ROUNDS if m else 0):
        for me, other in ((0, 1), (1, 0)):
            z = apply(weights[me], unlabelled[me])
            for value, share in ((1, rate), (0, 1 - rate)):
                free = np.flatnonzero(taken[other] == 0)
                k = int(round(SHARE * share * m))
                best = free[np.argsort(-z[free] if value else z[free], kind="stable")[:k]]
                best = best[(z[best] > 0) == bool(value)]
                taken[other][best] = 0.3
                told[other][best] = value
        for v in (0, 1):
            use = taken[v] > 0
            weights[v] = _train(np.r_[labelled[v], unlabelled[v][use]], np.r_[y, told[v][use]], np.r_[np.ones(n), taken[v][use]])
    model.views = weights
    # calibration on margins of models that have not seen the row's label
    fold = np.random.Generator(np.random.PCG64(seed)).permutation(n) % 4
    margins = np.zeros((n, 2))
    for f in range(4):
        out = fold == f
        if y[~out].min() == y[~out].max():
            margins[out] = [apply(w, x[out]) for w, x in zip(weights, labelled, strict=True)][0][:, None]
            continue
        for v in (0, 1):
            use = taken[v] > 0
            w = _train(np.r_[labelled[v][~out], unlabelled[v][use]], np.r_[y[~out], told[v][use]], np.r_[np.ones((~out).sum()), taken[v][use]])
            margins[out, v] = apply(w, labelled[v][out])
    model.calibration = [fit_logistic(margins[:, [v]], y, 0.01) for v in (0, 1)]
    z = np.c_[apply(model.calibration[0], margins[:, [0]]), apply(model.calibration[1], margins[:, [1]])]
    model.last = fit_logistic(np.clip(z, -8, 8), y, 0.1)
    return model


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def views_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """rows: text, source, lang, n_chars."""
    data, offsets = _joined([r[0] for r in rows])
    return content(data, offsets), metadata([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], data, offsets)


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, unlabelled: int = MAX_UNLABELLED) -> Model:
    d = docs.select("doc_id", "text", "source", "lang", "n_chars")
    rows = training_rows(d, labels, "quality", {1: per_class, 0: per_class})
    x = [(r["text"], r["source"], r["lang"], r["n_chars"]) for r in rows]
    y = np.array([r["label"] for r in rows], dtype=float)
    known = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = d.select("doc_id").where("doc_id IS NOT NULL").join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    more = d.join(F.broadcast(ids), "doc_id").select("text", "source", "lang", "n_chars").limit(unlabelled).collect()
    return fit(views_of(x), y, views_of([tuple(r) for r in more]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            meta = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            score = np.zeros(batch.num_rows)
            for lo, hi in chunks(offsets):
                piece, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                views = content(piece, at), metadata(*(m[lo:hi] for m in meta), piece, at)
                score[lo:hi] = model.value.score(views)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (of label 1, good), predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "source", "lang", "n_chars")
    return rows.mapInArrow(_score(model), SCHEMA)
