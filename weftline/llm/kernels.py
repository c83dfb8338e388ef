"""Vectorised hashing of bytes and word sequences for Arrow batches.

The hash of a run of units is a polynomial over random 64-bit values per unit,
modulo 2**64, taken from prefix sums, so any run costs O(1).  Runs are short (a
few hundred units at most): from about a thousand units on, alternating patterns
of two units would cancel out modulo 2**64.  Words, which may be of any length,
are hashed by sums over their bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once; one longer document is a chunk of its own.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_ROUND = 0xBF58476D1CE4E5B9
_PLACE = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_ROUND))


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            full = np.full(n, U64(self.base), dtype=U64)
            full[0] = 1
            back = np.full(n, U64(self.inverse), dtype=U64)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(full), np.multiply.accumulate(back)
        return self.up, self.down


_powers = _Powers(_BASE)


class Prefix:
    """Prefix sums of ``values`` (uint64) for substring hashes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers.get(n + 1)
        self.sums = np.empty(n + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(values * up[:n], out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        """Hash of values[start:end], elementwise."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in one array, and where each text starts.

    Nulls have no bytes.  No copy is made of the texts.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, dtype=np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        if (lengths[np.asarray(column.is_null())] != 0).any():
            column = column.fill_null("")
            return text_buffer(column)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes, or one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower

_space = np.ones(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words between ASCII white space.
NOT_SPACE = _space

_alnum = np.zeros(256, dtype=bool)
_alnum[0x30:0x3A] = True
_alnum[0x61:0x7B] = True
_alnum[0x80:] = True
#: Bytes of words of digits, small letters and anything beyond ASCII.
ALNUM = _alnum


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; no word crosses a document."""
    cls = is_word[data]
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = cls.copy()
    start[1:] &= ~cls[:-1] | edge[1:n]
    end = cls.copy()
    end[:-1] &= ~cls[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, 64-bit hashes of all words, and the index of each document's first word.

    A word's hash is the sum of one mixed value for each byte and its place in
    the word, so no pattern of bytes cancels out.  The bytes are hashed in
    pieces, however long a word is; memory follows the number of words.
    """
    if lower:
        data = LOWER[data]
    starts, ends = word_bounds(data, offsets, is_word)
    hashes = (ends - starts).astype(U64)
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
        if i == j:
            continue
        begin = np.maximum(starts[i:j], lo)
        n = np.minimum(ends[i:j], hi) - begin
        first = np.r_[0, np.cumsum(n)[:-1]]
        at = np.repeat(begin - first, n) + np.arange(int(n.sum()))
        place = (at - np.repeat(starts[i:j], n)).astype(U64)
        hashes[i:j] += np.add.reduceat(mix(BYTE_VALUES[data[at]] + place * U64(_PLACE)), first)
    return starts, ends, mix(hashes), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k units (those that start at 0 .. n-k)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    i = np.arange(n)
    return Prefix(words).hash(i, i + k)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as sorted disjoint spans that don't touch."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts, dtype=np.int64)[order], np.asarray(ends, dtype=np.int64)[order]
    top = np.maximum.accumulate(e)
    first = np.r_[True, s[1:] > top[:-1]]
    at = np.flatnonzero(first)
    return s[at], top[np.r_[at[1:] - 1, len(s) - 1]]


#: Segments below this size are finished by a plain sort of the characters that are left.
SMALL = 256


def multikey_quicksort(*characters: np.ndarray) -> np.ndarray:
    """The stable order of strings whose k-th characters are ``characters[k]``.

    A segment is parted by a pivot into strings with a smaller, an equal and a
    greater character; only the equal ones go on to the next character, so a
    character that many strings share is looked at once.
    """
    order = np.arange(len(characters[0]))
    open_segments = [(0, len(order), 0)]
    while open_segments:
        lo, hi, depth = open_segments.pop()
        if hi - lo < 2 or depth == len(characters):
            continue
        at = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = at[np.lexsort([c[at] for c in characters[: depth - 1 if depth else None : -1]])]
            continue
        c = characters[depth][at]
        pivot = np.partition(c[:: len(c) // 63], 31)[31]
        less, equal = c < pivot, c == pivot
        a = lo + int(np.count_nonzero(less))
        b = a + int(np.count_nonzero(equal))
        order[lo:hi] = np.concatenate([at[less], at[equal], at[~(less | equal)]])
        open_segments += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order
