"""Shared storage, lineage cuts and small helpers for the training-data operators."""

from __future__ import annotations

import atexit
import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, table  # noqa: F401

#: ASCII white space, [\x20\x09-\x0D], as a plain string for translate().
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Rows of a table that may be broadcast; every broadcast in this package is
#: bounded by construction or compared with this number first.
BROADCAST_ROWS = 100_000

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _file(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # the gateway may be gone already, or one path be unreachable
            continue


class Manifest:
    """A small JSON state below ``path``, in numbered versions that appear whole or not at all.

    A version is written under a name that no reader looks at and then renamed,
    so a crash before that leaves the version before it in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_manifest"

    def versions(self) -> list[int]:
        p, fs = _file(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self) -> dict | None:
        found = self.versions()
        if not found:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{found[-1]:08d}.json", wholetext=True).head()[0])

    def commit(self, state: dict) -> None:
        to, fs = _file(self.spark, f"{self.path}/{([0, *self.versions()][-1]) + 1:08d}.json")
        new, _ = _file(self.spark, f"{self.path}/.new-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(new, to):
            raise RuntimeError(f"another writer committed {to}")


#: Spark drops the shuffle files of a query that is done if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of one Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_lock = threading.Lock()
_writers: dict[int, list] = {}


@contextmanager
def _write_settings(spark: SparkSession) -> Iterator[None]:
    """The first of several writers sets the session's values, the last one restores them."""
    conf, key = spark.conf, id(spark)
    with _lock:
        state = _writers.setdefault(key, [0, {CLEANUP: conf.get(CLEANUP, "false"), BATCH: conf.get(BATCH)}])
        state[0] += 1
        conf.set(CLEANUP, "true")
        conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                for k, v in _writers.pop(key)[1].items():
                    conf.set(k, v)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write in small Arrow batches, then let go of the shuffle files of the job: nothing reads them again."""
    with _write_settings(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage in storage that outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def text_column(docs: DataFrame) -> int:
    """The place of the column ``text``; its type must be string."""
    return next(i for i, c in enumerate(docs.columns) if c.lower() == "text")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: At most this many groups can hold over 1/HOT_GROUPS of all rows.
HOT_GROUPS = 10_000
#: Rows of one key that a task takes without being split.
KEY_ROWS = 10_000


def hot_size(total: int) -> int:
    """Rows above which a group is hot; at most HOT_GROUPS groups of ``total`` rows are."""
    return max(1000, total // HOT_GROUPS)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with one-row-per-key ``groups``, without a hot task.

    Groups of over 1/HOT_GROUPS of the ``total`` rows (at most HOT_GROUPS of
    them) are joined by broadcast; their rows take keys of their own in the
    shuffled join of the rest.  Keys must not be null.
    """
    payload = [c for c in groups.columns if c not in keys]
    names = unused(rows.columns, *[f"__h{i}" for i in range(len(keys))], *[f"__c{i}" for i in range(len(keys))], "__hot", "__cold", "__s", "__c")
    h, c, (hot_, cold_, s_, c_) = names[: len(keys)], names[len(keys) : -4], names[-4:]
    hot = groups.where(F.col(size) > hot_size(total)).select(*[F.col(k).alias(n) for k, n in zip(keys, h, strict=True)], F.struct(*payload).alias(hot_))
    cold = groups.select(*[F.col(k).alias(n) for k, n in zip(keys, c, strict=True)], F.lit(0).cast("long").alias(c_), F.struct(*payload).alias(cold_))
    out = rows.join(F.broadcast(hot), [F.col(k) == F.col(n) for k, n in zip(keys, h, strict=True)], "left")
    # rows of hot groups are spread by a salt that no group has
    salt = F.when(F.col(hot_).isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    out = out.withColumn(s_, salt)
    out = out.join(cold, [*[F.col(k) == F.col(n) for k, n in zip(keys, c, strict=True)], F.col(s_) == F.col(c_)], "left")
    got = F.coalesce(hot_, cold_)
    return out.select(*[F.col(f"`{x}`") for x in rows.columns], *[got[x].alias(x) for x in payload])


def join_split(rows: DataFrame, other: DataFrame, key: str, by: list[str], total: int, per: int = KEY_ROWS) -> DataFrame:
    """``rows`` inner-joined with ``other`` on ``key``, where one key may hold most of the ``total`` rows.

    A key of over ``per`` rows (at most HOT_GROUPS of them are) is split over
    several tasks by a hash of the columns ``by``; its rows of ``other`` are
    repeated once for each of these.
    """
    per = max(per, total // HOT_GROUPS)
    if total <= per:
        return rows.join(other, key)
    parts = rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > per)
    parts = materialize(parts.select("__k", F.ceil(F.col("__n") / per).cast("int").alias("__p")), "split-keys")
    if parts.head() is None:
        return rows.join(other, key)
    hot, one = F.broadcast(parts), F.coalesce("__p", F.lit(1))
    left = rows.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.pmod(F.xxhash64(*by), one).cast("int"))
    right = other.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.explode(F.sequence(F.lit(0), one - 1)))
    return left.drop("__k", "__p").join(right.drop("__k", "__p"), [key, "__s"]).drop("__s")
