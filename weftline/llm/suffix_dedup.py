r"""Suffix-array dedup: removes every byte that a repeated 200-byte string covers.

A full suffix array of a large corpus takes many times its size, so the array is
sparse: of all suffixes, those that start at an anchor are kept, about one in
53 bytes, such that any two equal 200-byte strings hold the same anchor (see
``sparse_windows``).  A suffix is its first 96 bytes, and the hash of the bytes
that its windows cover.

Splitters are sampled suffixes of a share of documents and range-partition all
suffixes by these 96 bytes.  Each bucket is sorted by multikey quicksort, eight
bytes to a character, and the common prefixes of neighbours part it into
suffixes that agree in all 96 bytes; of these, equal contexts are settled.  All
suffixes that agree in 96 bytes lie between the same two splitters, so no pair
of equals lies across a boundary.  A suffix so frequent that it is several
splitters at once has the buckets between them, dealt by context.  Of copies in
one batch only one is sent, with a mark.  Suffixes that agree in 96 bytes but
not in their contexts are sorted again in a second round, now the suffixes at
all of their windows, and those that have 200 bytes in common with a neighbour
are repeated.

Defined cases: null texts are empty; matches never cross documents; rows that
repeat a doc_id are documents of their own; texts under 200 bytes lose nothing;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, chunks, merge_spans, mix, text_buffer
from .shared import materialize
from .sparse_windows import (
    PAYLOAD,
    RUNS,
    Spec,
    _compare,
    _records,
    bucket_count,
    exchange,
    fields_of,
    keyed,
    repeated_runs,
    sampled,
    suffixes,
    units_of,
    window_runs,
    with_spans,
)

LENGTH = 200
ANCHOR = 96
#: Sampled suffixes per splitter, about.
SAMPLES = 64

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sample(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in chunks(offsets):
                piece = data[offsets[lo] : offsets[hi]]
                values, first = units_of(piece, offsets[lo : hi + 1] - offsets[lo], "bytes")
                got = window_runs(values, first, spec)
                if got is not None:
                    raw = suffixes(piece, got[1], spec.gram).tobytes()
                    ends = np.arange(0, len(raw) + 1, spec.gram, dtype=np.int32)
                    flat = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([flat, pa.array(got[3].view(np.int64))], names=["s", "ctx"])

    return run


def splitters(rows: DataFrame, spec: Spec, buckets: int) -> np.ndarray:
    """buckets - 1 suffixes that part all suffixes evenly, as numbers in order (big-endian), from about SAMPLES samples for each."""
    sample = sampled(rows, buckets)[0].select("text").mapInArrow(_sample(spec), "s binary, ctx long")
    # thinned on the executors; copies of one context are sent once, so they count once
    sample = sample.distinct()
    size = max(1, sample.count() // (SAMPLES * buckets))
    got = [int.from_bytes(r[0], "big") for r in sample.where(F.pmod(F.xxhash64("s", "ctx"), F.lit(size)) == 0).select("s").toLocalIterator()]
    s = sorted(got) or [0]
    return np.array([s[i * len(s) // buckets] for i in range(1, buckets)], dtype=object)


def by_suffix(splitters: np.ndarray, width: int) -> Callable:
    """Buckets by the suffix; one that is several splitters has the buckets between them, by context."""
    cut = np.array([x.to_bytes(width, "big") for x in splitters], dtype=f"S{width}")

    def where(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(cut, r["suffix"], "left"), np.searchsorted(cut, r["suffix"], "right")
        several = high - low
        hot = several > 1
        spread = low + 1 + (mix(r["ctx"]) % np.maximum(several, 1).astype(U64)).astype(np.int64)
        return np.where(hot, spread, high), hot

    return where


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        starts, ns = batch.column(2), batch.column(3)
        n_removed, n_spans, digest = [], [], []
        for d in range(batch.num_rows):
            text = data[offsets[d] : offsets[d + 1]]
            if not starts[d].is_valid:
                n_removed.append(0), n_spans.append(0), digest.append(hashlib.sha256(text).hexdigest())
                continue
            s = starts[d].values.to_numpy()
            s, e = merge_spans(s, s + ns[d].values.to_numpy() - 1 + LENGTH)
            keep = hashlib.sha256()
            at = 0
            for a, z in zip(s.tolist(), e.tolist(), strict=True):
                keep.update(text[at:a])
                at = z
            keep.update(text[at:])
            n_removed.append(int((e - s).sum())), n_spans.append(len(s)), digest.append(keep.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(offsets)),
                pa.array(n_removed, type=pa.int64()),
                pa.array(n_spans, type=pa.int64()),
                pa.array(digest, type=pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, Spec]:
    """Keyed rows, and the runs (key, start, n) of their repeated windows."""
    spec = Spec("bytes", length, anchor, "anywhere")
    rows = keyed(docs)
    buckets = bucket_count(rows, spec)
    where = by_suffix(splitters(rows, spec, buckets), spec.gram)
    payload = rows.select("key", "ord", "text").mapInArrow(_records(spec, buckets, where), PAYLOAD)
    compared = exchange(payload, buckets).mapInArrow(_compare(spec.policy, fields=fields_of(spec)), RUNS)
    runs = materialize(compared.drop("bucket", "records"), "suffix-runs")
    return rows, repeated_runs(rows, runs, spec, buckets), spec


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    rows, repeated, spec = repeated_bytes(docs)
    return with_spans(rows, repeated, spec).mapInArrow(_cut, SCHEMA)
