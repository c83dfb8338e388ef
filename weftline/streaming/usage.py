"""Structured Streaming: token events to rollups and quota states, documents to deduplicated chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import COOLDOWN_MINUTES, DAILY_LIMIT, LIMITED_AT
from ..storage import fresh_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files of a Parquet table; the schema is read once."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}*")


def rollup_stream(events: DataFrame) -> DataFrame:
    """Tokens and requests by client and day.  Late events always count, so there is no watermark:
    state is one row for each client and day, and may be pruned with the events' own retention."""
    tokens = F.greatest(F.coalesce(F.floor("value"), F.lit(0)), F.lit(0)).cast("long")
    return events.groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("client_id")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("requests"))


def run_to_table(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process what is there, in update mode; the newest row of each key.

    Each micro-batch overwrites a folder of its own number, so a batch that is
    run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/number={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(path).drop("number")
    values = [c for c in rows.columns if c not in (*keys, "__batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("__batch")).alias("r"))
    return newest.select(*keys, "r.*")


QUOTA = "client_id long, day string, tokens long, status string"
QUOTA_STATE = "day string, tokens long, status string"


def _quota(limit: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, used, status = state.get if state.exists else ("", 0, "active")
        for rows in batches:
            per_day = rows.groupby("day")["tokens"].sum()
            for d, n in sorted(per_day.items()):
                if d > day:
                    day, used = d, 0
                if d == day:
                    used += int(n)
        if status != "suspended":
            status = "cooldown" if used >= limit else "limited" if used * 100 >= LIMITED_AT * limit else "active"
        state.update((day, used, status))
        yield pd.DataFrame({"client_id": [key[0]], "day": [day], "tokens": [used], "status": [status]})

    return step


def quota_stream(events: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """The quota state of each client after each micro-batch: usage of its latest day and the status that follows."""
    tokens = F.greatest(F.coalesce(F.floor("value"), F.lit(0)), F.lit(0)).cast("long")
    rows = events.select(F.col("user_id").alias("client_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), tokens.alias("tokens"))
    return rows.groupBy("client_id").applyInPandasWithState(_quota(limit), QUOTA, QUOTA_STATE, "update", GroupStateTimeout.NoTimeout)


def dedup_stream(docs: DataFrame) -> DataFrame:
    """The first document of each content over all batches: the hashes are the state, kept in the checkpoint."""
    from ..functions.text import content_hash

    return docs.withColumn("hash", content_hash(F.col("text"))).dropDuplicates(["hash"])


__all__ = ["COOLDOWN_MINUTES", "dedup_stream", "quota_stream", "read_stream", "rollup_stream", "run_to_table"]
