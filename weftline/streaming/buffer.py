"""Chunks embedded as a stream: a buffer that is flushed when full, by a timer and before a pause; contexts that become ready.

Records (``RECORD``) and commands (``COMMAND``) are files that are appended to
two folders and read as one stream, so commands take effect between
micro-batches.  A context's records are dealt over lanes by their content, which
spreads a context that holds much of the corpus and brings equal contents
together.  Each lane keeps at most ``FLUSH - 1`` records that are not embedded
yet, the digests it has embedded and, while its context is paused, the records
that came meanwhile; all of it is RocksDB state, read back one by one.

A pause flushes what is held and takes nothing more; as all records of a
micro-batch obey the same command, no page is left half done.  Resuming goes on
with what waited.  The last command by ``at`` counts, ties as a pause.

Defined cases: null or blank content is a failed record; a context's content is
embedded once and ``seen`` after that; a null context is one like any other;
commands for contexts without records change nothing; a page without chunks is
one failed record.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from . import lifecycle as L

#: Records embedded together, lanes of a context, and how long a record is held at most.
FLUSH, LANES, HOLD_MS = 32, 16, 30_000
#: Records that a task holds in memory before they go to the state or out.
SPILL = 1_000
#: Digests that a task holds in memory.
KNOWN = 100_000
#: Content of these characters alone is blank.
BLANK = " \t\n\r\v\f"

RECORD = "context_id string, page_id long, n_chunks int, chunk_id string, content string"
COMMAND = "context_id string, command string, at long"
DONE = "context_id string, lane int, page_id long, n_chunks int, chunk_id string, outcome string, flush long, flush_size int, reason string, digest string, vector array<double>"
_FIELDS = [f.split()[0] for f in DONE.split(", ")]
_HELD = "page_id long, n_chunks int, chunk_id string, content string"

Encoder = Callable[[list[str]], list[list[float]]]


class Buffer(StatefulProcessor):
    """One lane of a context."""

    def __init__(self, encode: Encoder, flush: int, hold_ms: int):
        self.encode, self.flush_at, self.hold_ms = encode, flush, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.waiting = handle.getListState("waiting", _HELD)
        self.embedded = handle.getMapState("embedded", "digest string", "flush long")
        self.lane = handle.getValueState("lane", "paused boolean, flushes long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.paused, self.flushes, self.due = self.lane.get() if self.lane.exists() else (False, 0, None)
        # a call to the state is a round trip: a lane that has embedded nothing before knows all that it has from this call
        self.known = None if self.embedded.exists() else set()
        fresh, commands = [], []
        # a command may come after the records that it holds back, so these are taken once all rows are seen
        for batch in rows:
            told = batch["command"].notna()
            commands += batch[told][["at", "command"]].itertuples(index=False, name=None)
            for r in batch[~told][["page_id", "n_chunks", "chunk_id", "content"]].itertuples(index=False, name=None):
                fresh.append(self._plain(r))
                if len(fresh) >= SPILL:
                    self.waiting.appendList(fresh)
                    fresh = []
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if commands:
            if any(c != "resume" for _, c in commands):
                yield from self._rows(self._flush(key, held, "pause"))
                held = []
            last = max(at for at, _ in commands)
            self.paused = any(c != "resume" for at, c in commands if at == last)
        if self.paused:
            if fresh:
                self.waiting.appendList(fresh)
        elif self.waiting.exists():
            yield from self._take(key, held, chain((tuple(r) for r in self.waiting.get()), fresh))
            self.waiting.clear()
        else:
            yield from self._take(key, held, fresh)
        self._keep(held, now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.paused, self.flushes, self.due = self.lane.get()
        self.known = None
        # a timer of records that went with an earlier flush says nothing about the present ones
        if self.due is not None and self.due <= expiredTimerInfo.getExpiryTimeInMs() and self.held.exists():
            yield from self._rows(self._flush(key, [tuple(r) for r in self.held.get()], "timer"))
            self._keep([], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    @staticmethod
    def _plain(record: tuple) -> tuple:
        page, n, chunk, content = (None if pd.isna(x) else x for x in record)
        return (None if page is None else int(page), None if n is None else int(n), chunk, content)

    def _take(self, key, held: list, records: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        """Add records to ``held``, which is emptied whenever it is full."""
        inside = {_digest(r[3]) for r in held}
        done: list[list] = []
        for r in records:
            if r[3] is None or not r[3].strip(BLANK):
                done.append([*key, *r[:3], "failed", None, None, None, None, None])
            elif (digest := _digest(r[3])) in inside or self._embedded(digest):
                done.append([*key, *r[:3], "seen", None, None, None, digest, None])
            else:
                inside.add(digest)
                held.append(r)
                if len(held) >= self.flush_at:
                    done += self._flush(key, held, "full")
                    held.clear()
                    inside.clear()
            if len(done) >= SPILL:
                yield from self._rows(done)
                done = []
        yield from self._rows(done)

    def _embedded(self, digest: str) -> bool:
        return self.embedded.containsKey((digest,)) if self.known is None else digest in self.known

    def _flush(self, key, held: list, reason: str) -> list[list]:
        if not held:
            return []
        self.flushes += 1
        done = []
        for r, vector in zip(held, self.encode([r[3] for r in held]), strict=True):
            digest = _digest(r[3])
            self.embedded.updateValue((digest,), (self.flushes,))
            if self.known is not None:
                self.known.add(digest)
            done.append([*key, *r[:3], "embedded", self.flushes, len(held), reason, digest, [float(x) for x in vector]])
        if self.known is not None and len(self.known) > KNOWN:
            self.known = None  # from here on the state is asked
        return done

    def _keep(self, held: list, now: int) -> None:
        if held:
            self.held.put(held)
            # the oldest record sets the time; after a flush in between it is early for the rest, never late
            if self.due is None:
                self.due = now + self.hold_ms
                self.handle.registerTimer(self.due)
        else:
            self.held.clear()
            self.due = None
        self.lane.update((self.paused, self.flushes, self.due))

    @staticmethod
    def _rows(done: list[list]) -> Iterator[pd.DataFrame]:
        if done:
            yield pd.DataFrame(done, columns=_FIELDS).astype({"lane": "Int32", "page_id": "Int64", "n_chunks": "Int32", "flush": "Int64", "flush_size": "Int32"})


def _digest(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def embedding_stream(records: DataFrame, commands: DataFrame, encode: Encoder, lanes: int = LANES, flush: int = FLUSH, hold_ms: int = HOLD_MS) -> DataFrame:
    """Rows of DONE, one for each record once it is embedded, seen before, or failed.  Both inputs are streams."""
    lane = F.pmod(F.xxhash64("content"), F.lit(lanes)).cast("int")
    said = records.select("context_id", lane.alias("lane"), "page_id", "n_chunks", "chunk_id", "content", F.lit(None).cast("string").alias("command"), F.lit(None).cast("long").alias("at"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in RECORD.split(", ")[1:])]
    told = commands.where("command IS NOT NULL").select("context_id", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *none, "command", F.coalesce("at", F.lit(0)).alias("at"))
    both = said.unionByName(told)
    return both.groupBy("context_id", "lane").transformWithStateInPandas(Buffer(encode, flush, hold_ms), DONE, "Update", "ProcessingTime")


def command(spark: SparkSession, folder: str, rows: list[tuple[str | None, str]]) -> None:
    """Append commands (context, 'pause' or 'resume') to the folder that the stream reads."""
    bad = {c for _, c in rows} - {"pause", "resume"}
    if bad:
        raise ValueError(f"no commands {sorted(bad)}")
    at = time.time_ns() // 1000  # pandas may hold it as a double
    spark.createDataFrame([(c, w, at + i) for i, (c, w) in enumerate(rows)], COMMAND).coalesce(1).write.mode("append").parquet(folder)


def run(stream: DataFrame, path: str, checkpoint: str, expected: Callable[[DataFrame], bool] | None = None, patience: float = 600, every: str = "500 milliseconds") -> DataFrame:
    """Write DONE rows below ``path`` until the input is used up and ``expected(rows so far)`` holds; the rows, with their ``number``."""
    spark, schema = stream.sparkSession, stream.schema

    def enough(_: StreamingQuery) -> bool:
        return expected is None or expected(L.changes(spark, path, schema))

    return L.run(stream, path, checkpoint, enough, every, patience)


def pages_done(done: DataFrame) -> DataFrame:
    """context_id, page_id, number (of the micro-batch that ended the page), indexed: pages all of whose chunks are done."""
    by = done.groupBy("context_id", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.coalesce("n_chunks", F.lit(1)), F.lit(1))).alias("of"), F.max("number").alias("number"), F.bool_or(F.col("outcome") != "failed").alias("indexed")
    )
    return by.where(F.col("n") >= F.col("of")).select("context_id", "page_id", "number", "indexed")


def readiness(done: DataFrame, registry: DataFrame, commands: DataFrame) -> DataFrame:
    """One row for each context of the registry (context_id, total_pages): its state and when it changed.

    ``status`` is paused after a last command that pauses, unless all is done;
    else ready once every page is done and one is indexed, failed if none is,
    partially_ready from the first indexed page, and discovering before that.
    ``partial_at`` and ``ready_at`` are the micro-batches of these changes.
    """
    per = pages_done(done).groupBy("context_id", "number").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("i"))
    total = registry.groupBy("context_id").agg(F.max("total_pages").alias("total_pages"))
    # one row for each context and micro-batch, however many pages
    so_far = Window.partitionBy("context_id").orderBy("number")
    per = per.withColumn("sum", F.sum("n").over(so_far))
    joined = total.alias("t").join(per.alias("p"), F.col("t.context_id").eqNullSafe(F.col("p.context_id")), "left")
    state = joined.groupBy(F.col("t.context_id").alias("context_id"), "total_pages").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("indexed"),
        F.min(F.when(F.col("i") > 0, F.col("number"))).alias("partial_at"),
        F.min(F.when(F.col("sum") >= F.col("total_pages"), F.col("number"))).alias("full_at"),
    )
    last = commands.groupBy(F.col("context_id").alias("c")).agg(F.max(F.struct(F.coalesce("at", F.lit(0)), (F.col("command") != "resume").alias("pause")))["pause"].alias("pause"))
    full, some = F.col("pages") >= F.col("total_pages"), F.col("indexed") > 0
    status = F.when(full & some, "ready").when(full, "failed").when(F.coalesce("pause", F.lit(False)), "paused").when(some, "partially_ready").otherwise("discovering")
    out = state.join(last, F.col("context_id").eqNullSafe(F.col("c")), "left").withColumn("status", status)
    return out.select("context_id", "status", "total_pages", "pages", "indexed", "partial_at", F.when(full & some, F.col("full_at")).alias("ready_at"))
