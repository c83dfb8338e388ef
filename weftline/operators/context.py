"""Citation contexts under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count, trim_tokens

SEPARATOR = "\n\n---\n\n"


def build_contexts(hits: DataFrame, budget: int = 1200) -> DataFrame:
    """query_id, context, n_sources, used_tokens from ranked hits.

    hits: query_id, rank, chunk_id, title, url, section, text, score.  Blank
    texts and repeats of (url, section, text) are left out; blocks are numbered,
    then taken while their tokens stay within the budget; a first block that
    alone exceeds it is cut to it.
    """
    clean = hits.withColumn("text", F.trim("text")).where("text <> ''")
    clean = clean.fillna("", ["title", "url", "section"])
    once = Window.partitionBy("query_id", "url", "section", "text").orderBy("rank")
    clean = clean.withColumn("__o", F.row_number().over(once)).where("__o = 1").drop("__o")
    order = Window.partitionBy("query_id").orderBy("rank")
    clean = clean.withColumn("position", F.row_number().over(order))
    block = F.concat(
        F.format_string("[S%d]\nTitle: ", "position"), "title", F.lit("\nURL: "), "url", F.lit("\nSection: "), "section",
        # this rounds the double itself; %.4f would round its shortest decimal form half up
        F.lit("\nRerank Score: "), F.call_function("format_number", F.col("score").cast("double"), F.lit("0.0000")), F.lit("\nContent:\n"), "text",
    )
    clean = clean.withColumn("block", block).withColumn("tokens", token_count(F.col("block")))
    clean = clean.withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    clean = clean.where((F.col("running") <= budget) | (F.col("position") == 1))
    shown = F.when(F.col("running") > budget, trim_tokens(F.col("block"), budget)).otherwise(F.col("block"))
    parts = F.sort_array(F.collect_list(F.struct("position", shown.alias("block"))))
    return clean.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["block"]), SEPARATOR).alias("context"),
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(F.when(F.col("running") <= budget, F.col("tokens")).otherwise(F.lit(0))).cast("long").alias("used_tokens"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "chunk_id"))), lambda p: p["chunk_id"]).alias("sources"),
    )
