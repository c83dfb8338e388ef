"""Tenants and their objects: readiness, cascades, backfills, logs, crawl summaries, checks of rankings, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

# States of a context.
READY = ("partially_ready", "ready")
BLOCKED = ("discovering", "processing_batch", "paused", "failed", "deleting", "ingesting")

MOST_LOG = 4000


def searchable_together(status: Column) -> Column:
    """Whether a context takes part in a search over all: only known ready states do."""
    return F.coalesce(status.isin(*READY), F.lit(False))


def searchable_alone(status: Column) -> Column:
    """Whether a named context is searched: unknown states pass."""
    return ~F.coalesce(status.isin(*BLOCKED), F.lit(False))


def in_scope(rows: DataFrame, scope: str | None, key: str = "client_id") -> DataFrame:
    """A client's rows; without a scope all of them."""
    return rows.where(F.col(key) == scope.strip()) if scope and scope.strip() else rows


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "client_id") -> dict[str, DataFrame]:
    """Every table without the rows of the clients in ``gone``; rows without a client stay."""
    keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def disable_objects(objects: DataFrame, clients: DataFrame, key: str = "client_id") -> DataFrame:
    """Objects with the state ``disabled`` where their client is disabled."""
    off = clients.where("status = 'disabled'").select(key).distinct().withColumn("__off", F.lit(True))
    joined = objects.join(off, key, "left")
    return joined.withColumn("status", F.when(F.col("__off"), F.lit("disabled")).otherwise(F.col("status"))).drop("__off")


def backfill_scope(rows: DataFrame, default: str, key: str = "client_id") -> DataFrame:
    """Rows without a client get the default one; running it again changes nothing."""
    k = F.trim(F.col(key))
    return rows.withColumn(key, F.when(F.coalesce(k, F.lit("")) == "", F.lit(default)).otherwise(k))


def without_default(value: Column, default: float) -> Column:
    """Null where a setting equals the platform's default, so that it follows it."""
    return F.when(value.try_cast("double") == float(default), F.lit(None)).otherwise(value)


def touch(objects: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Objects with ``last_accessed``, the time of their newest event, or null."""
    return objects.join(events.groupBy(key).agg(F.max("recorded_at").alias("last_accessed")), key, "left")


def latest_logs(logs: DataFrame, most: int = MOST_LOG) -> DataFrame:
    """The end of the newest log of each context (context_id, name, modified, text)."""
    newest = F.max_by(F.struct("name", "text"), F.struct("modified", "name"))
    return logs.groupBy("context_id").agg(newest.alias("r")).select("context_id", "r.name", F.right(F.col("r.text"), F.lit(most)).alias("preview"))


def crawl_summary(results: DataFrame) -> DataFrame:
    """Counts over crawl results (success, status); a null success is a failure."""
    return results.agg(
        F.count_if(F.coalesce("success", F.lit(False))).alias("succeeded"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"),
        F.count_if(F.col("status") == "blocked_domain").alias("blocked_domain"),
        F.count_if(F.col("status") == "blocked_robots").alias("blocked_robots"),
    )


def pair_error(query: Column, text: Column) -> Column:
    """Why a query and a text can't be scored, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(query), "query must not be empty").when(F.coalesce(text, F.lit("")) == "", "text is missing").when(blank(text), "invalid pair")


def ranking_holds(hits: DataFrame) -> DataFrame:
    """query_id, sorted: whether scores never rise from a rank to the next; of equal ranks the higher score comes first."""
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank", F.desc("score")))
    rises = hits.withColumn("__rises", F.coalesce(F.col("score") > before, F.lit(False)))
    return rises.groupBy("query_id").agg((~F.bool_or("__rises")).alias("sorted"))


def embed(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], prefix: str = "", batch_size: int = 32) -> DataFrame:
    """``df`` with ``embedding``, the unit vectors of prefix and text.

    The encoder gets at most ``batch_size`` texts at once, on the executors; it
    must be picklable.  A null text is encoded as the prefix alone; a zero
    vector stays zero.
    """
    schema = StructType([*df.drop("embedding").schema.fields, StructField("embedding", ArrayType(FloatType()))])
    rest = [c for c in df.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                v = np.asarray(encoder([prefix + (t or "") for t in part.column(part.schema.names.index(text)).to_pylist()]), dtype=np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                unit = (v / np.where(size == 0, 1, size)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(unit), type=pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return df.select(*rest).mapInArrow(run, schema)
