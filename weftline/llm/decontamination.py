r"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows are its runs of ``window`` words (or the whole item, if it is
shorter).  Each window is a set of short shingles; for exact containment the
necessary prefix is one shingle, and the rarest one is chosen, by counts over
all documents.  Documents are scanned for prefix shingles; a hit at word p for
a shingle at offset o of a window of length L leaves the only possible start
p-o (positional bound), which must lie within the document with L words to
follow (length bound).  Starts that remain are verified word by word.

Both passes are scans without a shuffle of documents; one scan counts the
shingles of all blocks, one finds the windows of all.  The benchmark side is
dealt into blocks of bounded bytes, and a process holds one block at a time, as
flat arrays: the words' bytes and hashes, and for each window the number of its
first word.  That is about seven times the text, 60 MB for a full block, and 200
MB while it is built.

Defined cases: null texts have no words; empty items have no window; equal
windows of several items are one window with several items; rows that repeat an
item_id count once; a null item_id is an item of its own with the name "null";
extra columns, whatever their names, are ignored and pass through;
an empty benchmark hits nothing; an empty document table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, U64, Prefix, chunks, gram_hashes, text_buffer, word_hashes
from .shared import materialize, text_column

WINDOW = 13
SHINGLE = 3
#: Bytes of benchmark text that are held at once.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if hits are at least 1 / SHARE of its words.
SHARE = 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """The windows of one block of items, as arrays over the words of all items in a row."""

    def __init__(self, items: Iterable[tuple], window: int, shingle: int):
        texts: list[bytes] = []
        hashes: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        first: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        of: list[np.ndarray] = []
        known: dict[tuple, int] = {}
        n_words = n_bytes = 0
        for item_id, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
            s, e, h, _ = word_hashes(data, np.array([0, len(data)]), ALNUM, False)
            length = min(window, len(s))
            if not length:
                continue
            raw = data.tobytes()
            texts.append(b" ".join([raw[a:z] for a, z in zip(s.tolist(), e.tolist(), strict=True)]) + b" ")
            hashes.append(h)
            ends.append((n_bytes + np.cumsum(e - s + 1)).astype(np.uint32))
            n = len(s) - length + 1
            first.append(np.arange(n_words, n_words + n, dtype=np.uint32))
            lengths.append(np.full(n, length, dtype=np.uint8 if window < 256 else np.uint32))
            of.append(np.full(n, known.setdefault((item_id is None, str(item_id)), len(known)), dtype=np.uint32))
            n_words, n_bytes = n_words + len(s), n_bytes + len(texts[-1])
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, dtype=t)
        self.text = b"".join(texts)
        del texts
        #: each word's bytes end one before its end here, with a space
        self.ends = np.r_[np.zeros(1, dtype=np.uint32), join(ends, np.uint32)]
        self.names = ["null" if null else name for null, name in known]
        self.hashes = join(hashes, U64)
        self._distinct(join(first, np.uint32), join(lengths, np.uint8), join(of, np.uint32))
        self.q = np.minimum(self.length, shingle)
        self.vocabulary = {int(q): np.unique(self._grams(q)[self._places(self.q == q, q)]) for q in np.unique(self.q)}

    def _distinct(self, first: np.ndarray, length: np.ndarray, of: np.ndarray) -> None:
        """Sets first, length, hash of the distinct windows, and the items of each (``item`` from ``items_at``)."""
        h = Prefix(self.hashes).hash(first.astype(np.int64), first.astype(np.int64) + length) if len(first) else np.zeros(0, dtype=U64)
        order = np.lexsort((of, length, h))
        first, length, of, h = first[order], length[order], of[order], h[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (length[1:] != length[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        for i in np.flatnonzero(~new).tolist():  # equal hashes are equal windows, but for a collision
            if self.words(first[i], length[i]) != self.words(first[head[i]], length[i]):
                new[i] = True
        group = np.cumsum(new) - 1
        pair = np.ones(len(of), dtype=bool)
        pair[1:] = (group[1:] != group[:-1]) | (of[1:] != of[:-1])
        self.first, self.length, self.hash = first[new], length[new], h[new]
        self.item = of[pair]
        self.items_at = np.searchsorted(group[pair], np.arange(len(self.first) + 1)).astype(np.uint32)

    def words(self, first: int, length: int) -> bytes:
        return self.text[self.ends[first] : self.ends[int(first) + int(length)] - 1]

    def _grams(self, q: int) -> np.ndarray:
        return gram_hashes(self.hashes, int(q))

    def _places(self, which: np.ndarray, q: int) -> np.ndarray:
        """Whether a shingle of the chosen windows starts at a word."""
        step = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(step, self.first[which].astype(np.int64), 1)
        np.add.at(step, self.first[which].astype(np.int64) + self.length[which] - int(q) + 1, -1)
        return (np.cumsum(step[:-1]) > 0)[: len(self.hashes) - int(q) + 1]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Sets the prefix of each window: its rarest shingle in the corpus.  counts: of each word of the vocabulary."""
        self.prefix = {}
        for q in np.unique(self.q).tolist():
            grams = self._grams(q)
            at = np.searchsorted(self.vocabulary[q], grams)
            at[at == len(self.vocabulary[q])] = 0
            seen = counts[q][at]
            keys, holders, offsets = [], [], []
            for length in np.unique(self.length[self.q == q]).tolist():
                mine = np.flatnonzero((self.q == q) & (self.length == length))
                for lo in range(0, len(mine), 100_000):
                    w = mine[lo : lo + 100_000]
                    f = self.first[w].astype(np.int64)
                    o = seen[f[:, None] + np.arange(length - q + 1)].argmin(axis=1)
                    some = seen[f + o] > 0  # a window with a shingle that no document has can't occur
                    keys.append(grams[f + o][some])
                    holders.append(w[some].astype(np.uint32))
                    offsets.append(o[some].astype(np.uint32))
            keys, holders, offsets = np.concatenate(keys), np.concatenate(holders), np.concatenate(offsets)
            order = np.argsort(keys, kind="stable")
            distinct, start = np.unique(keys[order], return_index=True)
            self.prefix[q] = (distinct, np.r_[start, len(keys)].astype(np.uint32), holders[order], offsets[order])
        self.hashes = self.vocabulary = None

    def nbytes(self) -> int:
        arrays = [v for v in vars(self).values() if isinstance(v, np.ndarray)]
        arrays += [a for p in getattr(self, "prefix", {}).values() for a in p] + list((self.vocabulary or {}).values())
        return len(self.text) + sum(a.nbytes for a in arrays)


def _member(needles: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``needles`` that are among ``sorted_keys``, and which they are."""
    if not len(sorted_keys) or not len(needles):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(sorted_keys, needles)
    at[at == len(sorted_keys)] = 0
    found = np.flatnonzero(sorted_keys[at] == needles)
    return found, at[found]


def _each(blocks: list) -> Iterator[tuple[int, object]]:
    """The values of broadcasts; of several, one at a time is held."""
    for i, block in enumerate(blocks):
        yield i, block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def _count(vocabularies: list):
    """Occurrences of the blocks' shingles in a partition of texts, by their place in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for b, vocabulary in _each(vocabularies):
                total = {q: np.zeros(len(v), dtype=np.int64) for q, v in vocabulary.items()}
                for lo, hi in chunks(offsets):
                    part = offsets[lo : hi + 1] - offsets[lo]
                    _, _, hashes, first = word_hashes(data[offsets[lo] : offsets[hi]], part, ALNUM, True)
                    doc = np.repeat(np.arange(hi - lo), np.diff(first))
                    for q, v in vocabulary.items():
                        g = gram_hashes(hashes, q)
                        if len(g):
                            g = g[doc[: len(g)] == doc[q - 1 :]]
                        _, which = _member(g, v)
                        total[q] += np.bincount(which, minlength=len(v))
                del vocabulary
                for q, n in total.items():
                    some = np.flatnonzero(n)
                    same = lambda x, k=len(some): pa.array(np.full(k, x, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([same(b), same(q), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["block", "q", "at", "n"])

    return run


def _found(windows: Windows, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of all windows that occur in a chunk."""
    doc, at, which = [], [], []
    prefix = Prefix(hashes)
    for q, (keys, holders_at, holders, offsets) in windows.prefix.items():
        found, key = _member(gram_hashes(hashes, q), keys)
        if not len(found):
            continue
        n = (holders_at[key + 1] - holders_at[key]).astype(np.int64)
        p = np.repeat(found, n)
        h = np.repeat(holders_at[key].astype(np.int64), n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        w, s = holders[h], p - offsets[h]
        d = np.searchsorted(first, p, "right") - 1
        length = windows.length[w].astype(np.int64)
        inside = np.flatnonzero((s >= first[d]) & (s + length <= first[d + 1]))
        w, s, d, length = w[inside], s[inside], d[inside], length[inside]
        same = np.flatnonzero(prefix.hash(s, s + length) == windows.hash[w])
        for i in same.tolist():  # verified by the words themselves
            a = s[i]
            said = b" ".join([part[x:y].tobytes() for x, y in zip(starts[a : a + length[i]].tolist(), ends[a : a + length[i]].tolist(), strict=True)])
            if said == windows.words(windows.first[w[i]], length[i]):
                doc.append(d[i]), at.append(a), which.append(w[i])
    return np.array(doc, dtype=np.int64), np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)


def examine(column: pa.Array, blocks: list) -> tuple[np.ndarray, np.ndarray, list[set[tuple]]]:
    """Words, hit words and items (block, number, name) of each text; ``blocks`` are broadcasts of Windows."""
    n = len(column)
    items: list[set[tuple]] = [set() for _ in range(n)]
    n_words, n_hit = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    data, offsets = text_buffer(column)
    data = LOWER[data]
    hit: dict[int, np.ndarray] = {}
    for b, windows in _each(blocks):
        for lo, hi in chunks(offsets):
            base = offsets[lo]
            part = data[base : offsets[hi]]
            starts, ends, hashes, first = word_hashes(part, offsets[lo : hi + 1] - base, ALNUM, False)
            n_words[lo:hi] = np.diff(first)
            if not len(hashes):
                continue
            doc, at, which = _found(windows, part, starts, ends, hashes, first)
            if not len(doc):
                continue
            step = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + windows.length[which], -1)
            covered = np.cumsum(step[:-1]) > 0
            hit[lo] = hit[lo] | covered if lo in hit else covered
            n_hit[lo:hi] = np.diff(np.r_[0, np.cumsum(hit[lo])][first])
            for d, w in zip(doc.tolist(), which.tolist(), strict=True):
                items[lo + d].update((b, int(i), windows.names[i]) for i in windows.item[windows.items_at[w] : windows.items_at[w + 1]])
    return n_words, n_hit, items


def _scan(blocks: list, share: int):
    """One output row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = examine(batch.column(1), blocks)
            names = [sorted({(name, name == "null" and (b, i)) for b, i, name in found}) for found in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array([len(i) for i in names], type=pa.int64()),
                    pa.array([hashlib.sha256(",".join(i[0] for i in x).encode()).hexdigest() for x in names], type=pa.string()),
                    pa.array((n_hit > 0) & (n_hit * share >= n_words)),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _keep(blocks: list, share: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, _ = examine(batch.column(text), blocks)
            keep = (n_hit == 0) | (n_hit * share < n_words)
            yield batch.filter(pa.array(keep))

    return run


def window_blocks(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark's windows, with prefixes chosen by counts over ``docs``."""
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text")
    total = bench.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))

    def windows_of(b: int) -> Windows:
        mine = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        return Windows(((r[0], r[1]) for r in mine.toLocalIterator()), window, shingle)

    vocabularies, sizes, only = [], [], None
    for b in range(n_blocks):
        windows = windows_of(b)
        vocabularies.append(spark.sparkContext.broadcast(windows.vocabulary))
        sizes.append({q: len(v) for q, v in windows.vocabulary.items()})
        only = windows if n_blocks == 1 else None
        del windows
    counted = docs.select("text").mapInArrow(_count(vocabularies), "block int, q int, at int, n long").groupBy("block", "q", "at").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "decon-counts")
    blocks = []
    for b in range(n_blocks):
        counts = {q: np.zeros(n, dtype=np.int64) for q, n in sizes[b].items()}
        for q, n in counts.items():  # at most one row per shingle of the block
            rows = counted.where((F.col("block") == b) & (F.col("q") == q)).select("at", "n").toArrow()
            n[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
        windows = only or windows_of(b)
        windows.choose(counts)
        blocks.append(spark.sparkContext.broadcast(windows))
        vocabularies[b].unpersist()
        only = windows = None
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    blocks = window_blocks(docs, benchmark, window, shingle, block_bytes)
    return docs.select("doc_id", "text").mapInArrow(_scan(blocks, share), SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns."""
    blocks = window_blocks(docs, benchmark, window, shingle, block_bytes)
    return docs.mapInArrow(_keep(blocks, share, text_column(docs)), docs.schema)
