"""Pages as a stream: each micro-batch is parsed, chunked and written; a restart goes on where the checkpoint ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, pages


def ingest(stream: DataFrame, path: str, checkpoint: str, **settings: int) -> None:
    """Chunks of the pages that ``stream`` (page_id, url, html) holds now, written to ``path``.

    A batch overwrites the folder of its number, so one that is run again after
    a failure replaces itself.  Calling it again with the same checkpoint takes
    new pages only; stopping between batches loses nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = pages.documents(batch).withColumn("source_file", F.format_string("%012d", "page_id"))
        pages.chunk_documents(docs, **settings).write.mode("overwrite").parquet(f"{path}/number={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def index(spark: SparkSession, path: str) -> DataFrame:
    """The ingested chunks, each content once over all batches."""
    return dedup.chunk_dedup(spark.read.parquet(path).drop("number"))
