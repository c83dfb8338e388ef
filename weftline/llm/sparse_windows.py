"""Repeated windows of a corpus, found exactly from a sparse sample of positions.

A window is ``length`` consecutive units (bytes or words) of one document.
Every window has an anchor: of the runs of ``gram`` units in it, the one with
the least hash (the last of equals).  The anchor depends on the window alone,
so equal windows have equal anchors at equal offsets.  Windows that follow each
other mostly share their anchor; such a run of windows is one record:

    lead   hash of the anchor
    ctx    hash of all units that the run's windows cover
    key, ord, start, n    its document, first window and number of windows

Records are combined within each batch, dealt into buckets, sorted there by
(lead, ctx) and compared.  Runs of bytes also carry the bytes of their anchor,
and these, not a hash, order and part them.  Equal (lead, ctx) settles whole
runs.  Where different contexts share a lead, one record of each context is
taken apart into its windows, which are compared in turn.  Leads that occur
once are done with: their windows occur once.

Two policies say when a window is repeated: "anywhere" (it starts at another
place) and "earlier" (it starts in a document of smaller ``ord``).

Equal contexts are combined per batch before the shuffle.  A lead that would
fill a bucket by itself (found in a sample) is dealt over several by its
contexts: equal contexts still meet, and that the lead has others is taken as
given, so all of its runs are compared window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_VALUES, NOT_SPACE, U64, Prefix, chunks, mix, multikey_quicksort, text_buffer, word_hashes
from .shared import materialize

#: Records that one bucket holds, about.
BUCKET_RECORDS = 500_000
FIELDS = (("lead", "<u8"), ("ctx", "<u8"), ("key", "<i8"), ("ord", "<i8"), ("start", "<i8"), ("n", "<i4"), ("flags", "u1"))
#: flags: other records of this lead and context were combined into this one;
#: it comes from an earlier batch and only serves as a source; its lead is dealt
#: over several buckets.
MULTI, HISTORY, HOT = 1, 2, 4
#: kinds of output rows: settled run; open run to take apart; source to take apart.
SETTLED, OPEN, SOURCE = 0, 1, 2
#: Contexts of one lead that are compared in one place; more are compared window by window.
WIDE = 20_000
#: Documents that are sampled for frequent leads and splitters, at least.
SAMPLE_DOCS = 5000
#: Windows that are sorted at once where contexts are compared.
AT_ONCE = 300_000

PAYLOAD = "bucket int, records binary, settled binary"
RUNS = "key long, ord long, start long, n int, kind int, lead long, bucket int, records binary"


@dataclass(frozen=True)
class Spec:
    units: str  # "bytes" or "words"
    length: int
    gram: int
    policy: str  # "anywhere" or "earlier"


def units_of(data: np.ndarray, offsets: np.ndarray, units: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit values of a chunk and where each document's begin."""
    if units == "bytes":
        return BYTE_VALUES[data], offsets
    _, _, hashes, first = word_hashes(data, offsets, NOT_SPACE, False)
    return hashes, first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


_POSITION = U64(0xFFFFFFFF)


def window_runs(values: np.ndarray, first: np.ndarray, spec: Spec):
    """(doc, anchor, lead, ctx, start, n) of all runs of windows in a chunk; positions are of the chunk."""
    n = len(values)
    if n < spec.length:
        return None
    prefix = Prefix(values)
    i = np.arange(n - spec.gram + 1)
    grams = prefix.hash(i, i + spec.gram)
    # the least hash wins, then the last position; 32 bits of each
    packed = (grams & ~_POSITION) | (_POSITION - i.astype(U64))
    anchors = (_POSITION - (sliding_min(packed, spec.length - spec.gram + 1) & _POSITION)).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    at = np.flatnonzero(doc[: n - spec.length + 1] == doc[spec.length - 1 :])
    if not len(at):
        return None
    a = anchors[at]
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    start = at[new]
    last = at[np.r_[new[1:] - 1, len(at) - 1]]
    return doc[start], a[new], grams[a[new]], prefix.hash(start, last + spec.length), start, (last - start + 1).astype(np.int32)


def fields_of(spec: Spec) -> tuple:
    """Runs of bytes have the bytes of their anchor."""
    return (*FIELDS, ("suffix", f"S{spec.gram}")) if spec.units == "bytes" else FIELDS


def pack(r: dict[str, np.ndarray], at=slice(None)) -> bytes:
    n = len(r["lead"][at])
    fields = (*FIELDS, ("suffix", r["suffix"].dtype)) if "suffix" in r else FIELDS
    return b"".join([np.int64(n).tobytes(), *(np.ascontiguousarray(r[f][at], dtype=t).tobytes() for f, t in fields)])


def unpack(payloads: list[bytes], fields: tuple = FIELDS) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {f: [] for f, _ in fields}
    for p in payloads:
        n, at = int(np.frombuffer(p, dtype=np.int64, count=1)[0]), 8
        for f, t in fields:
            v = np.frombuffer(p, dtype=t, count=n, offset=at)
            parts[f].append(v)
            at += v.nbytes
    return {f: np.concatenate(v) if v else np.zeros(0, dtype=t) for (f, t), v in zip(fields, parts.values(), strict=True)}


def take(r: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {f: v[at] for f, v in r.items()}


def combine(r: dict[str, np.ndarray], policy: str) -> tuple[dict, dict]:
    """Of one batch: the records to compare further, and the settled runs."""
    n = len(r["lead"])
    order = np.lexsort((r["ord"], r["ctx"], r["lead"]))
    r = take(r, order)
    new = np.r_[True, (r["lead"][1:] != r["lead"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])] if n else np.zeros(0, dtype=bool)
    if policy == "anywhere":
        group = np.cumsum(new) - 1
        many = (np.bincount(group, minlength=0)[group] >= 2) if n else new
        r["flags"] = r["flags"] | (many & new).astype(np.uint8) * np.uint8(MULTI)
        return take(r, new), take(r, ~new)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    later = r["ord"] > r["ord"][first] if n else new
    return take(r, ~later), take(r, later)


def settle(r: dict[str, np.ndarray], policy: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Compares all records of a bucket: runs that are settled or must be taken apart, their kind, and whether their lead is wide."""
    n = len(r["lead"])
    if not n:
        return r, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    if "suffix" in r:
        suffix = r.pop("suffix")
        order, lcp = suffix_order(suffix)
        new_lead = lcp < suffix.dtype.itemsize
        r = take(r, order)
        r = take(r, np.lexsort((r["ord"], r["ctx"], np.cumsum(new_lead))))
    else:
        r = take(r, multikey_quicksort(r["lead"], r["ctx"], r["ord"]))
        new_lead = np.r_[True, r["lead"][1:] != r["lead"][:-1]]
    new = new_lead | np.r_[True, r["ctx"][1:] != r["ctx"][:-1]]
    group, lead = np.cumsum(new) - 1, np.cumsum(new_lead) - 1
    hot = (r["flags"] & HOT) > 0
    shared = (np.bincount(lead[new])[lead] >= 2) | hot
    history = (r["flags"] & HISTORY) > 0
    if policy == "anywhere":
        seen = np.bincount(group, weights=1 + (r["flags"] & MULTI))[group] >= 2
        kind = np.where(seen, SETTLED, np.where(shared, OPEN, -1))
        kind = np.where(new & shared & seen, SOURCE, kind)
    else:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        later = r["ord"] > r["ord"][first]
        kind = np.where(later, np.where(history, -1, SETTLED), np.where(shared, np.where(history, SOURCE, OPEN), -1))
    wide = (np.bincount(lead[new])[lead] > WIDE) | hot
    keep = np.flatnonzero(kind >= 0)
    return take(r, keep), kind[keep].astype(np.int32), wide[keep]


def suffix_order(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte strings, by multikey quicksort, and the common bytes of each with the one before it."""
    width = suffix.dtype.itemsize
    words = suffix.view(">u8").reshape(len(suffix), width // 8)
    characters = [words[:, k].astype(U64) for k in range(width // 8)]
    order = multikey_quicksort(*characters)
    return order, 8 * common_characters(characters, order)


def common_characters(characters: list, order: np.ndarray) -> np.ndarray:
    """Leading characters that each string has in common with its neighbour before it in ``order``; 0 for the first."""
    n = len(order)
    common = np.zeros(n, dtype=np.int64)
    same = np.arange(1, n)
    for c in characters:
        same = same[c[order[same]] == c[order[same - 1]]]
        if not len(same):
            break
        common[same] += 1
    return common


def groups(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(edges, [*edges[1:], len(values)], strict=True))


def _send(r: dict[str, np.ndarray], policy: str, buckets: int, where: Callable) -> Iterator[pa.RecordBatch]:
    """A batch's records as payload rows, one per bucket that gets any."""
    send, done = combine(r, policy)
    done.pop("suffix", None)
    to, hot = where(send)
    send["flags"] = np.where(hot, send["flags"] | np.uint8(HOT), send["flags"]).astype(np.uint8)
    out: dict[int, list[bytes]] = {}
    for k, part, to in ((0, send, to), (1, done, (mix(done["key"].view(U64)) % U64(buckets)).astype(np.int64))):
        order = np.argsort(to, kind="stable")
        part, to = take(part, order), to[order]
        for lo, hi in groups(to):
            if k:  # position and length are all that is needed of these
                at = slice(lo, hi)
                body = b"".join([np.int64(hi - lo).tobytes(), *(np.ascontiguousarray(part[f][at], dtype=t).tobytes() for f, t in FIELDS[2:6])])
            else:
                body = pack(part, slice(lo, hi))
            out.setdefault(int(to[lo]), [b"", b""])[k] = body
    if out:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(out), type=pa.int32()),
                pa.array([v[0] for v in out.values()], type=pa.binary()),
                pa.array([v[1] for v in out.values()], type=pa.binary()),
            ],
            names=["bucket", "records", "settled"],
        )


def _unsettle(p: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(p, dtype=np.int64, count=1)[0]), 8, []
    for _, t in FIELDS[2:6]:
        out.append(np.frombuffer(p, dtype=t, count=n, offset=at))
        at += out[-1].nbytes
    return out


def by_lead(buckets: int, hot: np.ndarray | None = None) -> Callable:
    """Buckets by the hash of the lead; of the leads ``hot`` (sorted) by that of the context as well."""

    def where(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        spread = np.zeros(len(r["lead"]), dtype=bool)
        if hot is not None and len(hot):
            at = np.searchsorted(hot, r["lead"])
            at[at == len(hot)] = 0
            spread = hot[at] == r["lead"]
        h = np.where(spread, mix(r["lead"] ^ (r["ctx"] >> U64(1))), r["lead"])
        return ((h >> U64(16)) % U64(buckets)).astype(np.int64), spread

    return where


def _sample_leads(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in chunks(offsets):
                values, first = units_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], spec.units)
                got = window_runs(values, first, spec)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[2].view(np.int64)), pa.array(got[3].view(np.int64))], names=["lead", "ctx"])

    return run


def sampled(rows: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """A share of the documents, by hash of their key, that grows with the corpus; and one in how many it is."""
    share = max(1, rows.count() // max(SAMPLE_DOCS, 8 * buckets))
    return rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0), share


def frequent_leads(rows: DataFrame, spec: Spec, buckets: int) -> list[int]:
    """Leads with so many contexts that they would fill half a bucket or more, sorted as unsigned numbers.

    At most two for each bucket can have that many; the sample holds about ten
    records or more of each.
    """
    sample, share = sampled(rows, buckets)
    least = max(8, BUCKET_RECORDS // 2 // share)
    contexts = sample.select("text").mapInArrow(_sample_leads(spec), "lead long, ctx long").distinct()
    found = contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("lead")
    return np.sort(np.array([r[0] for r in found.collect()], dtype=np.int64).view(U64)).view(np.int64).tolist()


#: Bytes of text whose records are combined before they are sent.
COMBINE_BYTES = 8 << 20


def _records(spec: Spec, buckets: int, where: Callable):
    """Map side: rows of (key, ord, text) to payload rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        held = 0
        for batch in batches:
            keys, ords = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in chunks(offsets):
                piece = data[offsets[lo] : offsets[hi]]
                values, first = units_of(piece, offsets[lo : hi + 1] - offsets[lo], spec.units)
                got = window_runs(values, first, spec)
                held += len(piece)
                if got is None:
                    continue
                doc, anchor, lead, ctx, start, n = got
                parts.append(
                    {
                        "lead": lead,
                        "ctx": ctx,
                        "key": keys[lo + doc],
                        "ord": ords[lo + doc],
                        "start": start - first[doc],
                        "n": n,
                        "flags": np.zeros(len(n), dtype=np.uint8),
                    }
                )
                if spec.units == "bytes":
                    parts[-1]["suffix"] = suffixes(piece, anchor, spec.gram)
                if held >= COMBINE_BYTES:
                    yield from _send({f: np.concatenate([p[f] for p in parts]) for f in parts[0]}, spec.policy, buckets, where)
                    parts, held = [], 0
        if parts:
            yield from _send({f: np.concatenate([p[f] for p in parts]) for f in parts[0]}, spec.policy, buckets, where)

    return run


def suffixes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of the suffixes that start at ``at``."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[at]).view(f"S{width}").ravel()


def each_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The payloads of one bucket after another; rows come sorted by bucket."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if now is not None and b != now:
                yield now, held
                held = [[] for _ in range(columns)]
            now = b
            for c in range(columns):
                if len(p := batch.column(1 + c)[i].as_buffer()) if batch.column(1 + c)[i].is_valid else 0:
                    held[c].append(p)
    if now is not None:
        yield now, held


def _run_rows(r: dict, kind: np.ndarray, wide: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of RUNS; the lead is there for runs to take apart, unless it is a wide one."""
    lead = pa.nulls(len(kind), pa.int64()) if wide is None else pa.array(r["lead"].view(np.int64), mask=wide | (kind == SETTLED))
    none = [pa.nulls(len(kind), pa.int32()), pa.nulls(len(kind), pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array(r["key"]), pa.array(r["ord"]), pa.array(r["start"]), pa.array(r["n"]), pa.array(kind.astype(np.int32)), lead, *none],
        names=["key", "ord", "start", "n", "kind", "lead", "bucket", "records"],
    )


def log_row(bucket: int, r: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row with the sorted first occurrences of a bucket's new (lead, ctx)."""
    r = take(r, np.flatnonzero((r["flags"] & HISTORY) == 0))
    r = take(r, np.lexsort((r["ord"], r["ctx"], r["lead"])))
    new = np.ones(len(r["lead"]), dtype=bool)
    new[1:] = (r["lead"][1:] != r["lead"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])
    r = take(r, new)
    r["flags"] = HISTORY | (r["flags"] & HOT)
    none = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.int32())] * 2 + [pa.nulls(1, pa.int64())]
    return pa.RecordBatch.from_arrays(
        [*none, pa.array([bucket], type=pa.int32()), pa.array([pack(r)], type=pa.binary())],
        names=["key", "ord", "start", "n", "kind", "lead", "bucket", "records"],
    )


def _compare(policy: str, log: bool = False, fields: tuple = FIELDS):
    """Reduce side: payload rows, sorted by bucket, to runs (and rows of a log, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (records, settled) in each_bucket(batches, 2):
            all_records = unpack(records, fields)
            if log:
                yield log_row(bucket, all_records)
            r, kind, wide = settle(all_records, policy)
            del all_records
            for lo in range(0, len(kind), 100_000):
                at = slice(lo, lo + 100_000)
                yield _run_rows(take(r, at), kind[at], wide[at])
            for p in settled:
                key, ord_, start, n = _unsettle(p)
                yield _run_rows({"key": key, "ord": ord_, "start": start, "n": n}, np.zeros(len(n), dtype=np.int32))

    return run


def _contexts(spec: Spec, buckets: int):
    """Open runs with the bytes that their windows cover.  Input: key, text, start[], n[], kind[], lead[]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_buffer(batch.column(1))
            lists = [batch.column(i) for i in (2, 3, 4, 5)]
            counts = np.diff(np.asarray(lists[0].offsets))
            start, n, kind, lead = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            to = ((lead.view(U64) >> U64(16)) % U64(buckets)).astype(np.int64)
            begin = offsets[doc] + start
            size = n.astype(np.int64) + spec.length - 1
            order = np.lexsort((lead, to))
            out: list[tuple[int, bytes]] = []
            for lo, hi in groups(to[order]):
                at = order[lo:hi]
                body = b"".join(data[b : b + s].tobytes() for b, s in zip(begin[at].tolist(), size[at].tolist(), strict=True))
                head = [np.int64(len(at)), lead[at], keys[doc[at]], start[at].astype(np.int64), n[at].astype(np.int32), kind[at].astype(np.uint8)]
                out.append((int(to[at[0]]), b"".join([*(np.ascontiguousarray(h).tobytes() for h in head), body])))
            if out:
                none = pa.nulls(len(out), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], type=pa.int32()), pa.array([o[1] for o in out], type=pa.binary()), none],
                    names=["bucket", "records", "settled"],
                )

    return run


def _unpack_contexts(payloads: list, length: int):
    """lead, key, start, n, kind of all runs, sorted by lead, and each one's payload and place in it."""
    fields, where, place = [[] for _ in range(5)], [], []
    for i, p in enumerate(payloads):
        m, at = int(np.frombuffer(p, dtype=np.int64, count=1)[0]), 8
        for f, t in enumerate(("<i8", "<i8", "<i8", "<i4", "u1")):
            fields[f].append(np.frombuffer(p, dtype=t, count=m, offset=at))
            at += fields[f][-1].nbytes
        size = fields[3][-1].astype(np.int64) + length - 1
        place.append(at + np.r_[0, np.cumsum(size)[:-1]])
        where.append(np.full(m, i, dtype=np.int32))
    lead, key, start, n, kind, where, place = (np.concatenate(x) for x in (*fields, where, place))
    order = np.argsort(lead, kind="stable")
    return tuple(x[order] for x in (lead, key, start, n, kind, where, place))


class _Character:
    """The k-th eight bytes of strings that start at ``start``, as one big-endian number each."""

    def __init__(self, words: np.ndarray, start: np.ndarray, shift: int):
        self.words, self.start, self.shift = words, start, U64(shift)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, at) -> np.ndarray:
        return self.words[self.start[at]] >> self.shift


def window_characters(body: np.ndarray, start: np.ndarray, length: int) -> list[_Character]:
    """The strings of ``length`` bytes at ``start``, eight bytes to a character; they aren't copied."""
    padded = np.zeros(len(body) + 8, dtype=np.uint8)
    padded[: len(body)] = body
    words = np.zeros(len(body) + 1, dtype=U64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(U64) << U64(56 - 8 * k)
    return [_Character(words, start + k, 8 * max(0, k + 8 - length)) for k in range(0, length, 8)]


def _compare_contexts(spec: Spec):
    """Repeated windows of open runs, one bucket of leads after another, whole leads at once.

    The windows are suffixes, compared by their bytes: they are sorted by multikey
    quicksort, and a window that has all of its bytes in common with a neighbour
    is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (payloads,) in each_bucket(batches, 1):
            lead, key, start, n, kind, where, place = _unpack_contexts(payloads, spec.length)
            views = [np.frombuffer(p, dtype=np.uint8) for p in payloads]
            first = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
            windows = np.r_[0, np.cumsum(n.astype(np.int64))]
            lo = 0
            while lo < len(lead):
                # as many whole leads as fit, at least one
                hi = int(np.searchsorted(windows, windows[lo] + AT_ONCE, "right")) - 1
                k = int(np.searchsorted(first, hi, "right"))
                hi = int(first[k - 1]) if k and first[k - 1] > lo else (int(first[k]) if k < len(first) else len(lead))
                if windows[-1] - windows[lo] <= AT_ONCE:
                    hi = len(lead)
                s = slice(lo, hi)
                size = n[s].astype(np.int64) + spec.length - 1
                body = np.concatenate([views[w][p : p + z] for w, p, z in zip(where[s].tolist(), place[s].tolist(), size.tolist(), strict=True)])
                base = np.r_[0, np.cumsum(size)[:-1]]
                count = n[s].astype(np.int64)
                owner = np.repeat(np.arange(hi - lo), count)
                step = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
                characters = window_characters(body, base[owner] + step, spec.length)
                order = multikey_quicksort(*characters)
                same = common_characters(characters, order)[1:] == len(characters)
                twice = np.zeros(len(owner), dtype=bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice &= kind[s][owner] == OPEN
                at = np.flatnonzero(twice)
                if len(at):
                    new = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]
                    b = np.flatnonzero(new)
                    length = np.diff(np.r_[b, len(at)])
                    o = owner[at[b]]
                    found = {"key": key[s][o], "ord": key[s][o], "start": start[s][o] + step[at[b]], "n": length.astype(np.int32)}
                    yield _run_rows(found, np.zeros(len(b), dtype=np.int32))
                lo = hi

    return run


def _take_apart(spec: Spec, buckets: int):
    """Windows of runs to take apart, as payload rows.  Input: key, ord, text, start[], n[], kind[]."""
    where = by_lead(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            keys, ords = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            data, offsets = text_buffer(batch.column(2))
            starts, ns, kinds = (batch.column(i) for i in (3, 4, 5))
            for d in range(batch.num_rows):
                piece = data[offsets[d] : offsets[d + 1]]
                values, _ = units_of(piece, np.array([0, len(piece)]), spec.units)
                n = ns[d].values.to_numpy().astype(np.int64)
                first = np.repeat(starts[d].values.to_numpy() - np.r_[0, np.cumsum(n)[:-1]], n)
                at = first + np.arange(len(first))
                old = np.repeat(kinds[d].values.to_numpy() == SOURCE, n)
                if not len(at):
                    continue
                parts.append(
                    {
                        "lead": Prefix(values).hash(at, at + spec.length),
                        # a second hash, so that windows are equal if 128 bits are
                        "ctx": Prefix(mix(values ^ U64(0x5DEECE66D1CE4E5B))).hash(at, at + spec.length),
                        "key": np.full(len(at), keys[d]),
                        "ord": np.full(len(at), ords[d]),
                        "start": at,
                        "n": np.ones(len(at), dtype=np.int32),
                        "flags": np.where(old & (spec.policy == "earlier"), HISTORY, 0).astype(np.uint8),
                    }
                )
                if sum(len(p["lead"]) for p in parts) > 1_000_000:
                    yield from _send({f: np.concatenate([p[f] for p in parts]) for f in parts[0]}, spec.policy, buckets, where)
                    parts = []
            if parts:
                yield from _send({f: np.concatenate([p[f] for p in parts]) for f in parts[0]}, spec.policy, buckets, where)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """key (unique), ord, doc_id, text.  ord is the doc_id, nulls last.

    Where doc_ids are unique they are the keys; else rows are numbered once, in
    a table of the shared folder, so that the numbers hold for later reads.
    """
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").head(1)
    rows = docs.select("doc_id", "text")
    ord_ = F.coalesce("doc_id", F.lit(2**63 - 1))
    if not twice:
        return rows.select(F.col("doc_id").alias("key"), ord_.alias("ord"), "doc_id", "text")
    numbered = materialize(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows-numbered")
    return numbered.select("key", ord_.alias("ord"), "doc_id", "text")


def bucket_count(rows: DataFrame, spec: Spec) -> int:
    """Enough buckets for the records that the corpus will give."""
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    per_record = (spec.length - spec.gram + 2) / 2 * (1 if spec.units == "bytes" else 6)
    # a run of bytes is thrice as large as one of words
    return max(8, int(total / per_record / BUCKET_RECORDS * (2 if spec.units == "bytes" else 1)) + 1)


def exchange(payload: DataFrame, buckets: int) -> DataFrame:
    """One partition for each bucket."""
    return payload.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")


def repeated_runs(rows: DataFrame, runs: DataFrame, spec: Spec, buckets: int, sources: DataFrame | None = None) -> DataFrame:
    """key, start, n of all repeated windows, from the runs that a comparison gave.

    Open runs of bytes travel with the bytes that they cover and are compared
    lead by lead; those of hot leads and of leads with more than WIDE contexts,
    and open runs of words, travel as hashes of their windows (two of 64 bits),
    which any bucket can take.

    sources: further rows (key, ord, text) that runs of kind SOURCE may refer to.
    """
    open_runs = runs.where(F.col("kind") > SETTLED)
    texts = rows.select("key", "ord", "text")
    if sources is not None:
        texts = texts.unionByName(sources.select("key", "ord", "text"))
    done = (F.col("kind") == SETTLED) | (F.col("kind") == SOURCE) if spec.policy == "anywhere" else F.col("kind") == SETTLED
    out = runs.where(done).select("key", "start", "n")
    narrow = F.col("lead").isNotNull() if spec.units == "bytes" else F.lit(False)
    for chosen, kind_of in ((open_runs.where(narrow), "contexts"), (open_runs.where(~narrow), "windows")):
        if chosen.head() is None:
            continue
        apart = (
            chosen.groupBy("key", "ord")
            .agg(F.collect_list(F.struct("start", "n", "kind", "lead")).alias("r"))
            .select(F.col("key").alias("k"), F.col("ord").alias("o"), *[F.col(f"r.{c}").alias(c) for c in ("start", "n", "kind", "lead")])
        )
        joined = texts.join(apart, (F.col("key") == F.col("k")) & (F.col("ord") == F.col("o")))
        if kind_of == "contexts":
            payload = joined.select("key", "text", "start", "n", "kind", "lead").mapInArrow(_contexts(spec, buckets), PAYLOAD)
            found = exchange(payload, buckets).mapInArrow(_compare_contexts(spec), RUNS)
        else:
            most = max(buckets, -(-int(chosen.agg(F.sum("n")).head()[0]) // BUCKET_RECORDS))
            payload = joined.select("key", "ord", "text", "start", "n", "kind").mapInArrow(_take_apart(spec, most), PAYLOAD)
            found = exchange(payload, most).mapInArrow(_compare(spec.policy), RUNS)
        found = materialize(found.where(F.col("kind") == SETTLED).select("key", "start", "n"), kind_of)
        out = out.unionByName(found)
    return out


def with_spans(rows: DataFrame, repeated: DataFrame, spec: Spec) -> DataFrame:
    """``rows`` with the arrays ``starts`` and ``ends`` (in units) of their repeated spans."""
    spans = (
        repeated.groupBy(F.col("key").alias("k"))
        .agg(F.collect_list(F.struct("start", "n")).alias("r"))
        .select("k", F.col("r.start").alias("starts"), F.col("r.n").alias("ns"))
    )
    return rows.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "starts", "ns")
