r"""Fill-in-the-middle transformation with a sparse checkpoint index.

A text is cut into units: a word with the white space before it, and white space
at the end.  One pass in pieces counts them and records the byte and code-point
offsets after every EVERY-th unit.  A cut after a given unit is found by binary
search among the checkpoints and a scan of less than EVERY units from there, so
neither all unit offsets nor a list of tokens is ever held: a text costs its own
bytes and one checkpoint per EVERY units.

Prefix, middle and suffix are put in one of two orders, each with a marker
before it; texts that hold a marker, and a share of all, stay as they are.  All
draws come from a hash of the doc_id, so reruns agree.

Defined cases: null counts as empty; an empty text is plain and has no units;
texts of white space are one unit; cuts may coincide, so any part may be empty;
a null doc_id draws as the empty string; equal rows give equal rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, chunks, text_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Per cent of the texts that are transformed, and of these the ones with the suffix first.
RATE, SPM = 50, 80
#: Units between checkpoints, and bytes that are counted at once.
EVERY, PIECE = 256, 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Checkpoints:
    """The number of units of a UTF-8 text, and its offsets after every ``every``-th one."""

    def __init__(self, data: np.ndarray, every: int = EVERY, piece: int = PIECE):
        self.data, self.every = data, every
        self.bytes, self.chars = [0], [0]
        self.n, chars = 0, 0
        for lo in range(0, len(data), piece):
            part = data[lo : lo + piece]
            word = NOT_SPACE[part]
            after = np.zeros(len(part), dtype=bool)
            after[:-1] = word[1:]
            if lo + piece < len(data):
                after[-1] = NOT_SPACE[data[lo + piece]]
            ends = np.flatnonzero(word & ~after) + 1
            at = ends[every - 1 - self.n % every :: every]
            if len(at):
                self.bytes += (lo + at).tolist()
                points = np.cumsum((part & 0xC0) != 0x80)
                self.chars += (chars + points[at - 1]).tolist()
            self.n += len(ends)
            chars += code_points(part)
        if len(data) and not NOT_SPACE[data[-1]]:
            self.n += 1  # white space at the end
            if self.n % every == 0:
                self.bytes.append(len(data)), self.chars.append(chars)

    def after(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset after ``unit`` units."""
        # checkpoint i lies after i * every units
        i = bisect_right(range(0, len(self.bytes) * self.every, self.every), unit) - 1
        at, chars, rest = self.bytes[i], self.chars[i], unit - i * self.every
        if not rest:
            return at, chars
        end = next(islice(_UNIT.finditer(self.data, at), rest - 1, None)).end()
        return end, chars + code_points(self.data[at:end])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four reproducible numbers of 32 bits."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(said[4 * i : 4 * i + 4], "big") for i in range(4)]


def transform(doc_id: int | None, data: np.ndarray, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    index = Checkpoints(data)
    text = data.tobytes()
    h = draws(doc_id, seed)
    if not text or h[2] % 100 >= RATE or any(m in text for m in _MARKERS):
        return index.n, "plain", None, None, text
    first, last = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.after(first), index.after(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = _MARKERS
    if h[3] % 100 < SPM:
        return index.n, "spm", a_chars, b_chars - a_chars, b"".join([s, suffix, p, prefix, m, middle])
    return index.n, "psm", a_chars, b_chars - a_chars, b"".join([p, prefix, s, suffix, m, middle])


def _transform(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in chunks(offsets):
                rows = [transform(ids[d], data[offsets[d] : offsets[d + 1]], seed) for d in range(lo, hi)]
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns[:4], columns[4].cast(pa.string())], names=_NAMES)

    return run


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_transform(seed), SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that an output came from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` did, with digests of the outputs and of the texts rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    return out.select(*_NAMES[:5], sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
