r"""Substring dedup over a log-structured index of window fingerprints.

A window is 13 consecutive words.  The index is a log of immutable runs, each
sorted by fingerprint and dealt into the same buckets: a fingerprint stands for
a run of windows with the same anchor (see ``sparse_windows``), with the
document in which it came first.  A new batch is sorted and merge-joined with
all runs, bucket by bucket.  Equal fingerprints of equal context settle whole
runs of windows; where only the anchor agrees, windows are verified one by one.
Then the batch's own first occurrences become a new run; ``compact`` merges
runs into one, keeping the first document of each fingerprint.

A word is removed if a window that covers it also starts in a document with a
smaller doc_id.

Defined cases: null texts have no words; texts under 13 words lose nothing; a
null doc_id ranks after all others; rows that repeat a doc_id don't remove from
each other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import merge_spans, text_buffer
from .shared import Manifest, delete_path, scratch_path, write_parquet
from .sparse_windows import (
    HOT,
    PAYLOAD,
    RUNS,
    Spec,
    _compare,
    _records,
    bucket_count,
    by_lead,
    each_bucket,
    exchange,
    frequent_leads,
    keyed,
    log_row,
    repeated_runs,
    unpack,
    with_spans,
)

LENGTH = 13
ANCHOR = 5
SPEC = Spec("words", LENGTH, ANCHOR, "earlier")

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log rows of several runs, sorted by bucket, to one log row per bucket."""
    for bucket, (records,) in each_bucket(batches, 1):
        r = unpack(records)
        r["flags"] &= np.uint8(HOT)
        yield log_row(bucket, r)


class FingerprintIndex:
    """Sorted immutable runs below one folder of the shared storage.

    A manifest names the runs, the number of buckets and the frequent leads; it
    is replaced in one step once a run is written, so a crash before that leaves
    the index as it was.  Opening an index by its path goes on where the last
    commit ended; ``buckets`` and ``hot`` hold for a fresh index only.
    """

    def __init__(self, spark: SparkSession, buckets: int = 8, path: str | None = None, most_runs: int = 8, hot: list[int] | None = None):
        self.spark, self.most_runs = spark, most_runs
        self.path = path or scratch_path(spark, "fingerprints")
        self.manifest = Manifest(spark, self.path)
        state = self.manifest.load() or {"buckets": buckets, "hot": hot or [], "runs": [], "length": LENGTH, "anchor": ANCHOR}
        if (state["length"], state["anchor"]) != (LENGTH, ANCHOR):
            raise ValueError(f"{self.path} holds windows of another length")
        self.state = state
        self.old: list[str] = []

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def _commit(self, runs: list[str]) -> None:
        state = self.state | {"runs": runs}
        self.manifest.commit(state)
        self.state = state

    def log(self) -> DataFrame:
        rows = self.spark.read.schema(RUNS).parquet(*[f"{self.path}/{r}" for r in self.runs])
        return rows.select("bucket", "records").where("records IS NOT NULL")

    def compare(self, rows: DataFrame, append: bool = True) -> DataFrame:
        """Runs of windows of the batch ``rows`` (key, ord, text) that are settled or open.

        With ``append`` the batch becomes a run of the index; one pass writes
        both the matches and the sorted run.
        """
        where = by_lead(self.buckets, np.array(self.state["hot"], dtype=np.int64).view(np.uint64))
        payload = rows.select("key", "ord", "text").mapInArrow(_records(SPEC, self.buckets, where), PAYLOAD)
        if self.runs:
            payload = payload.unionByName(self.log().withColumn("settled", F.lit(None).cast("binary")))
        found = exchange(payload, self.buckets).mapInArrow(_compare(SPEC.policy, append), RUNS)
        name = f"run-{uuid.uuid4().hex}"
        write_parquet(found, f"{self.path}/{name}")
        if append:
            self._commit([*self.runs, name])
            if len(self.runs) > self.most_runs:
                self.compact()
        return self.spark.read.schema(RUNS).parquet(f"{self.path}/{name}").where("kind IS NOT NULL").drop("bucket", "records")

    def compact(self) -> None:
        """Merge all runs into one, which keeps the first document of each fingerprint."""
        if not self.runs:
            return
        name, old = f"run-{uuid.uuid4().hex}", self.runs
        write_parquet(exchange(self.log(), self.buckets).mapInArrow(_merge, RUNS), f"{self.path}/{name}")
        # runs that were merged stay on disk while matches that lie beside them may be read
        self._commit([name])
        self.old += old

    def vacuum(self) -> None:
        """Delete the runs that were merged; matches of their batches can't be read afterwards."""
        for p in self.old:
            delete_path(self.spark, f"{self.path}/{p}")
        self.old = []


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        spans, ns = batch.column(2), batch.column(3)
        n_words, n_removed, digest = [], [], []
        for d in range(batch.num_rows):
            text = data[offsets[d] : offsets[d + 1]]
            words = text.tobytes().split()
            total = len(words)
            if spans[d].is_valid:
                s = spans[d].values.to_numpy()
                s, e = merge_spans(s, s + ns[d].values.to_numpy() - 1 + LENGTH)
                kept, at = [], 0
                for a, z in zip(s.tolist(), e.tolist(), strict=True):
                    kept += words[at:a]
                    at = z
                words = kept + words[at:]
            n_words.append(total), n_removed.append(total - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(digest, type=pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def remove_known(docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, append: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of the batch ``docs``.

    index: fingerprints of earlier batches; history: the documents of those
    batches (doc_id, text), read only to verify windows one by one.
    """
    rows = keyed(docs)
    if index is None:
        buckets = bucket_count(rows, SPEC)
        index = FingerprintIndex(docs.sparkSession, buckets, hot=frequent_leads(rows, SPEC, buckets))
    runs = index.compare(rows, append)
    sources = None if history is None else keyed(history)
    return with_spans(rows, repeated_runs(rows, runs, SPEC, index.buckets, sources), SPEC).mapInArrow(_strip, SCHEMA)
