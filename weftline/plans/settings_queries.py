"""Queries over settings tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settings as S
from ..storage import fresh_path, table


def _raw(spark, sf):
    c = table(spark, sf, "customer")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("c_custkey") % len(v) + 1).cast("int"))
    return c.select(
        "c_custkey", pick(" m1 ", "", None).alias("model"), pick("5", "90", "x", "0").alias("timeout_seconds"), pick("3", "-1", "0", None, "0.7").alias("temperature"),
        pick("10", "2000", None).alias("max_output_tokens"), pick("0", "9").alias("max_retries"), pick("0.1", "4", "y").alias("retry_backoff"), pick("-5", "2000").alias("daily_token_limit"),
    )


def generation_settings(spark, sf):
    return S.clamp_generation(_raw(spark, sf))


def _prompts(spark, sf):
    b = table(spark, sf, "benchmark")
    role = F.when(F.col("item_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Role "), F.col("item_id").cast("string")))
    own = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("item_id") % 3 == 1, F.array(F.lit("Be kind"), F.lit(" be KIND "), F.lit("Always answer yes"))).otherwise(
        F.array(F.lit("Short"), F.lit(" "))
    )
    return b.select("item_id", role.alias("role"), own.alias("constraints"))


def prompt_normalized(spark, sf):
    p = S.normalize_prompt(_prompts(spark, sf), "Assistant", ["Use the context"])
    return p.select("item_id", "role", F.array_join("constraints", "|").alias("constraints"))


def prompt_validation(spark, sf):
    return _prompts(spark, sf).select("item_id", S.prompt_error(F.col("role"), F.col("constraints")).alias("error"))


DEFAULTS = ("Assistant", ["Use the context"])


def stored_settings(spark, sf):
    """All prompts saved, some saved anew, some of those reset, and read back with ids that were never saved."""
    path, at = fresh_path(spark, "settings"), lambda n: F.timestamp_seconds(F.lit(n))
    p = _prompts(spark, sf).withColumn("setting_id", F.col("item_id").cast("long"))
    S.save_prompts(p, path, DEFAULTS, "first", at(1))
    S.save_prompts(p.where(F.col("setting_id") % 2 == 0).withColumn("role", F.lit(" Guide ")), path, DEFAULTS, "second", at(2))
    S.reset_prompts(p.where(F.col("setting_id") % 5 == 0), path, DEFAULTS, "third", at(3))
    ids = p.select("setting_id").unionByName(p.select((-F.col("setting_id") - 1).alias("setting_id")))
    s = S.load_prompts(spark, path, ids, DEFAULTS)
    return s.select("setting_id", "role", F.array_join("constraints", "|").alias("constraints"), F.unix_timestamp("last_modified").alias("saved"), "last_modified_by")


QUERIES = {
    "stored_settings": (
        stored_settings,
        """WITH i AS (SELECT DISTINCT item_id::BIGINT AS i FROM benchmark), k AS (SELECT i AS setting_id, i FROM i UNION ALL SELECT -i - 1, NULL FROM i)
        SELECT setting_id, CASE WHEN i IS NULL OR i % 5 = 0 THEN 'Assistant' WHEN i % 2 = 0 THEN 'Guide' WHEN i % 4 = 0 THEN 'Assistant' ELSE 'Role ' || i END AS role,
        CASE WHEN i IS NULL OR i % 5 = 0 THEN 'Use the context' ELSE ['Use the context', 'Be kind', 'Short'][i % 3 + 1] END AS constraints,
        CASE WHEN i % 5 = 0 THEN 3 WHEN i % 2 = 0 THEN 2 WHEN i IS NOT NULL THEN 1 END::BIGINT AS saved,
        CASE WHEN i % 5 = 0 THEN 'third' WHEN i % 2 = 0 THEN 'second' WHEN i IS NOT NULL THEN 'first' END AS last_modified_by FROM k""",
    ),
    "generation_settings": (
        generation_settings,
        """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'm1' ELSE 'default' END AS model, [10.0, 90.0, 60.0, 60.0][c_custkey % 4 + 1]::DOUBLE AS timeout_seconds,
        [2.0, 0.0, 0.0, 0.2, 0.7][c_custkey % 5 + 1]::DOUBLE AS temperature, [64.0, 2000.0, 1024.0][c_custkey % 3 + 1]::DOUBLE AS max_output_tokens,
        [3.0, 9.0][c_custkey % 2 + 1]::DOUBLE AS max_retries, [0.5, 4.0, 2.0][c_custkey % 3 + 1]::DOUBLE AS retry_backoff, [0.0, 2000.0][c_custkey % 2 + 1]::DOUBLE AS daily_token_limit FROM customer""",
    ),
    "prompt_normalized": (
        prompt_normalized,
        """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'Assistant' ELSE 'Role ' || item_id END AS role, ['Use the context', 'Be kind', 'Short'][item_id % 3 + 1] AS constraints FROM benchmark""",
    ),
    "prompt_validation": (
        prompt_validation,
        """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'Role cannot be empty.' WHEN item_id % 3 = 0 THEN 'Constraints cannot be empty.'
        WHEN item_id % 3 = 2 THEN 'Constraints cannot contain blank entries.' END AS error FROM benchmark""",
    ),
}
