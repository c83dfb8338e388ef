"""State with a life: cooldowns that end by a timer, rollups whose state expires.

Both use arbitrary stateful processing, which keeps its state in RocksDB; the
session's store is set for the run and set back afterwards.  Each micro-batch
writes a folder of its own number, so one that runs again after a failure
replaces itself, and a restart from the checkpoint goes on with all timers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.usage import COOLDOWN_MINUTES, DAILY_LIMIT, KEEP_DAYS, LIMITED_AT

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

QUOTA = "client_id long, day string, tokens long, status string, cooldown_until long, changed long, swept boolean"
ROLLUP = "day string, client_id long, life long, tokens long, requests long"


def _tokens():
    return F.greatest(F.coalesce(F.floor("value"), F.lit(0)), F.lit(0)).cast("long")


class Cooldowns(StatefulProcessor):
    """Usage of a client's latest day and its status; a cooldown ends at its time, whether events come or not."""

    def __init__(self, limit: int, cooldown_ms: int):
        self.limit, self.cooldown_ms = limit, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quota = handle.getValueState("quota", "day string, tokens long, status string, cooldown_until long")

    def _row(self, key, day, tokens, status, until, now, swept) -> pd.DataFrame:
        values = [key[0], day, tokens, status, until, now, swept]
        out = pd.DataFrame([values], columns=["client_id", "day", "tokens", "status", "cooldown_until", "changed", "swept"])
        return out.astype({"client_id": "Int64", "cooldown_until": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        day, used, status, until = self.quota.get() if self.quota.exists() else ("", 0, "active", None)
        for batch in rows:
            for d, n in sorted(batch.groupby("day")["tokens"].sum().items()):
                if d > day:
                    day, used = d, 0
                if d == day:
                    used += int(n)
        now = timerValues.getCurrentProcessingTimeInMs()
        if status != "cooldown" and used >= self.limit:
            status, until = "cooldown", now + self.cooldown_ms
            self.handle.registerTimer(until)
        elif status != "cooldown":
            status = "limited" if used * 100 >= LIMITED_AT * self.limit else "active"
        self.quota.update((day, used, status, until))
        yield self._row(key, day, used, status, until, now, False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, used, status, until = self.quota.get()
        # a timer of an earlier cooldown says nothing about the present one
        if status == "cooldown" and until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.quota.update((day, used, "active", None))
            yield self._row(key, day, used, "active", None, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, limit: int = DAILY_LIMIT, cooldown_ms: int = COOLDOWN_MINUTES * 60_000) -> DataFrame:
    """Rows of QUOTA: a client's state whenever events or the end of its cooldown change it."""
    rows = events.select(F.col("user_id").alias("client_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), _tokens().alias("tokens"))
    rows = rows.where("day IS NOT NULL")
    return rows.groupBy("client_id").transformWithStateInPandas(Cooldowns(limit, cooldown_ms), QUOTA, "Update", "ProcessingTime")


class Rollup(StatefulProcessor):
    """Tokens and requests of a client's days, each since its state was made; a day's state goes ``keep_ms`` after its last event.

    The days of a client are one group: each call to the state is a round trip,
    so a day costs one to write, and one to read where the client has any.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "day string", "life long, tokens long, requests long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        days: dict[str | None, list[int]] = {}
        for r in rows:
            new = days.setdefault(r["day"], [0, 0])
            new[0] += r["tokens"]
            new[1] += 1
        known = self.sums.exists()
        for day, (tokens, requests) in days.items():
            at = (day or "",)  # a date is never empty
            life, t, n = (self.sums.getValue(at) if known else None) or (now, 0, 0)
            self.sums.updateValue(at, (life, t + tokens, n + requests))
            yield Row(day=day, client_id=key[0], life=life, tokens=t + tokens, requests=n + requests)

    def close(self) -> None:
        pass


def expiring_rollup(events: DataFrame, keep_ms: int = KEEP_DAYS * 86_400_000) -> DataFrame:
    """Rows of ROLLUP: the sums of a client's day in the present life of its state.

    A late event whose state is gone begins a new life, so its sums are added to
    those that earlier lives left in the table, and never replace them: state is
    bounded by what was active in ``keep_ms``, and no event is lost.
    """
    rows = events.select(F.col("user_id").alias("client_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), _tokens().alias("tokens"))
    return rows.groupBy("client_id").transformWithState(Rollup(keep_ms), ROLLUP, "Update", "ProcessingTime")


def merged_rollup(rows: DataFrame) -> DataFrame:
    """The stored rollup: the newest row of each life, summed over lives.  rows: ROLLUP and the micro-batch ``number``."""
    newest = rows.groupBy("day", "client_id", "life").agg(F.max_by(F.struct("tokens", "requests"), "number").alias("r"))
    return newest.groupBy("day", "client_id").agg(F.sum("r.tokens").alias("tokens"), F.sum("r.requests").alias("requests"))


def newest_states(rows: DataFrame) -> DataFrame:
    """The state of each client after its last change.  rows: QUOTA and the micro-batch ``number``."""
    # within a micro-batch a timer fires after the rows are handled
    last = F.max_by(F.struct("day", "tokens", "status", "cooldown_until"), F.struct("number", "swept"))
    newest = rows.groupBy("client_id").agg(last.alias("r"), F.bool_or("swept").alias("swept"))
    return newest.select("client_id", "r.*", "swept")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run(stream: DataFrame, path: str, checkpoint: str, enough: Callable[[StreamingQuery], bool] | None = None, every: str = "500 milliseconds", patience: float = 600) -> DataFrame:
    """Write all changes of ``stream`` below ``path`` until its input is used up and ``enough(query)`` says so.

    Returns what is there, with the ``number`` of the micro-batch of each row.
    Without ``enough`` the run ends with its input; timers that are due later
    fire in a later run.  ``patience`` (seconds) is for what ``enough`` waits
    for; input is read however long it takes.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/number={number}")

    with rocksdb(spark):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(processingTime=every).start()
        try:
            until = None
            # timers keep micro-batches coming, so a run has read its input when one of them had none
            while not (used_up(query) and (enough is None or enough(query))):
                until = (until or time.monotonic() + patience) if used_up(query) else None
                if until is not None and time.monotonic() > until:
                    raise TimeoutError("the stream did not reach the state that was waited for")
                if query.exception() is not None:
                    raise query.exception()
                time.sleep(0.25)
        finally:
            query.stop()
    return changes(spark, path, stream.schema)


def used_up(query: StreamingQuery) -> bool:
    """No rows in the last micro-batch.  The first one of a run says nothing: it may be one that an earlier run had begun."""
    progress = query.recentProgress
    return len({p["batchId"] for p in progress}) > 1 and progress[-1]["numInputRows"] == 0


def changes(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the micro-batches that are written whole; a run may stop within one, and the next run writes it again."""
    names = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, number int"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # one folder a micro-batch
    found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], names)
    return spark.read.option("basePath", path).schema(names).parquet(*whole)


def sweep(stream: DataFrame, path: str, checkpoint: str, **settings) -> DataFrame:
    """Run a cooldown stream until no client is in cooldown any more; the newest state of each client."""
    spark, schema = stream.sparkSession, stream.schema

    def nobody_waits(_: StreamingQuery) -> bool:
        return newest_states(changes(spark, path, schema)).where("status = 'cooldown'").head() is None

    return newest_states(run(stream, path, checkpoint, nobody_waits, **settings))
