"""Shingles of normalised texts as 64-bit hashes, a batch of texts at once.

Catalyst evaluates a lambda for each shingle, which took most of the time of a
similarity join; here a word is hashed once, by sums over its bytes and their
places, and a shingle by a sum over its words and their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer document is taken in pieces.
PIECE = 1 << 20
_BYTE, _PLACE = U64(0xBF58476D1CE4E5B9), U64(0xD1342543DE82EF95)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each document's first."""
    space = data == 0x20
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    sums = np.zeros(len(starts), dtype=U64)
    for lo in range(0, len(data), PIECE):
        hi = min(lo + PIECE, len(data))
        # the first word of a piece may have begun before it
        i, j = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))
        at = np.maximum(starts[i:j], lo) - lo
        place = np.arange(lo, hi) - np.repeat(starts[i:j], np.diff(np.r_[at, hi - lo]))
        value = _mix((data[lo:hi].astype(U64) + U64(1)) * _BYTE + place.astype(U64) * _PLACE)
        value[space[lo:hi]] = 0
        sums[i:j] += np.add.reduceat(value, at)
    return _mix(sums), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a shorter text is one shingle, an empty one none.  Words are parted by one space."""
    if not len(data):
        return [np.zeros(0, dtype=np.int64)] * (len(offsets) - 1)
    words, first = _words(data, offsets)
    places = _mix(np.arange(1, size + 1, dtype=U64))
    runs = np.zeros(max(len(words) - size + 1, 0), dtype=U64)
    for k in range(size):
        runs += _mix(words[k : k + len(runs)] ^ places[k])
    runs = _mix(runs).view(np.int64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if 0 < hi - lo < size:
            out.append(_mix(_mix(words[lo:hi] ^ places[: hi - lo]).sum(keepdims=True) + U64(hi - lo)).view(np.int64))
        else:
            out.append(np.unique(runs[lo : max(hi - size + 1, lo)]))
    return out


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        yield from shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        lo = hi


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in values])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *values])))


def sets(size: int):
    """Batches of (id, text) to (id, s): all shingles of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(_sets(batch.column(1), size)))], names=["id", "s"])

    return run


def each(size: int):
    """Batches of (text) to (g): each shingle of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *_sets(batch.column(0), size)]))], names=["g"])

    return run


def prefixes(size: int, threshold: float, common):
    """Batches of (id, hash, text) to (id, hash, n, prefix): the rarest of the n shingles of a text.

    ``common`` is a broadcast pair of arrays, shingles in their order and how often they were met; others count 0, and equal counts go by hash.
    A set that reaches the threshold with this one has one of the prefix in its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common.value
        for batch in batches:
            n, out = [], []
            for s in _sets(batch.column(2), size):
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                met = np.where(known[at] == s, count[at], 0) if len(known) else np.zeros(len(s), dtype=np.int64)
                # a product that rounds up must not shorten the prefix
                most = len(s) - int(np.ceil(len(s) * threshold - 1e-9)) + 1 if len(s) else 0
                n.append(len(s))
                out.append(s[np.argsort(met, kind="stable")][:most])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), _lists(out)], names=["id", "hash", "n", "prefix"])

    return run
