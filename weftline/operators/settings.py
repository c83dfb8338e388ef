"""Settings tables: tolerant coercion, clamps, defaults, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import sanitize

MOST_ROLE = 1000


@dataclass(frozen=True)
class GenerationDefaults:
    """Values for what a client leaves out; the bounds of ``clamp_generation`` hold for them too."""

    model: str = "default"
    timeout_seconds: float = 60.0
    temperature: float = 0.2
    max_output_tokens: float = 1024.0
    max_retries: float = 3.0
    retry_backoff: float = 2.0


def number_or(value: Column, default: float) -> Column:
    """The number that a setting holds; nothing, zero and what is no number give the default."""
    n = value.try_cast("double")
    return F.when(n.isNull() | (n == 0), F.lit(float(default))).otherwise(n)


def clamp_generation(df: DataFrame, defaults: GenerationDefaults | None = None) -> DataFrame:
    """Generation settings within their bounds, from columns of any type."""
    d = defaults or GenerationDefaults()
    least = lambda c, low: F.greatest(number_or(F.col(c), getattr(d, c)), F.lit(float(low)))
    model = F.trim(F.coalesce(F.col("model"), F.lit("")))
    temperature = F.coalesce(F.col("temperature").try_cast("double"), F.lit(d.temperature))
    return df.withColumns(
        {
            "model": F.when(model == "", d.model).otherwise(model),
            "timeout_seconds": least("timeout_seconds", 10),
            "temperature": F.least(F.lit(2.0), F.greatest(F.lit(0.0), temperature)),
            "max_output_tokens": least("max_output_tokens", 64),
            "max_retries": least("max_retries", 1),
            "retry_backoff": least("retry_backoff", 0.5),
            "daily_token_limit": F.greatest(number_or(F.col("daily_token_limit"), 0), F.lit(0.0)),
        }
    )


def truth(value: Column, default: bool) -> Column:
    """1, true, yes, on and their opposites in any case; other numbers by being zero; else the default."""
    t = F.lower(F.trim(value.cast("string")))
    n = t.try_cast("double")
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).when(n.isNotNull(), n != 0).otherwise(default)


def distinct_constraints(constraints: Column) -> Column:
    """Trimmed entries without blanks; of those that differ in case only, the first."""
    clean = F.filter(F.transform(constraints, lambda c: F.trim(c)), lambda c: c != "")

    def fresh(seen: Column, c: Column) -> Column:
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(c))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(c)))

    return F.aggregate(clean, F.array().cast("array<string>"), fresh)


def normalize_prompt(df: DataFrame, default_role: str, default_constraints: list[str]) -> DataFrame:
    """role (cut to MOST_ROLE characters) and constraints, with defaults, without what contradicts grounding."""
    role = F.substring(F.trim(F.coalesce("role", F.lit(""))), 1, MOST_ROLE)
    own = distinct_constraints(F.coalesce("constraints", F.array().cast("array<string>")))
    fallback = F.array(*[F.lit(c) for c in default_constraints])
    return df.withColumns({"role": F.when(role == "", default_role).otherwise(role), "constraints": sanitize(F.when(F.size(own) == 0, fallback).otherwise(own))})


def prompt_error(role: Column, constraints: Column) -> Column:
    """Why prompt settings are turned down, or null."""
    return (
        F.when(F.trim(F.coalesce(role, F.lit(""))) == "", "Role cannot be empty.")
        .when(F.coalesce(F.size(constraints), F.lit(0)) <= 0, "Constraints cannot be empty.")
        .when(F.exists(constraints, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""), "Constraints cannot contain blank entries.")
    )


#: A row of the table of settings; each save and each reset adds rows, and the newest of an id counts.
STORED = "setting_id long, role string, constraints array<string>, last_modified timestamp, last_modified_by string"


def save_prompts(prompts: DataFrame, path: str, defaults: tuple[str, list[str]], changed_by: str = "api", at: Column | None = None) -> None:
    """Add setting_id, role, constraints to the table, normalised; nothing is turned down.

    defaults: role and constraints.  Saving the defaults is ``reset_prompts``.
    """
    clean = normalize_prompt(prompts.select("setting_id", "role", "constraints"), *defaults)
    stamped = clean.withColumns({"last_modified": F.current_timestamp() if at is None else at, "last_modified_by": F.lit(changed_by)})
    stamped.select("setting_id", "role", "constraints", "last_modified", "last_modified_by").write.mode("append").parquet(path)


def reset_prompts(ids: DataFrame, path: str, defaults: tuple[str, list[str]], changed_by: str = "api", at: Column | None = None) -> None:
    """Back to the defaults for each setting_id; earlier rows stay as history."""
    nothing = ids.select("setting_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("array<string>").alias("constraints"))
    save_prompts(nothing, path, defaults, changed_by, at)


def load_prompts(spark: SparkSession, path: str, ids: DataFrame, defaults: tuple[str, list[str]]) -> DataFrame:
    """The settings in force of each distinct setting_id of ``ids``: the newest saved ones, normalised again, or the defaults.

    An id without rows, or a table that isn't there yet, gives the defaults
    with a null time and author.  Of rows saved at one time, the greatest by
    author, role and constraints counts.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    rows = spark.read.schema(STORED).parquet(path) if there else spark.createDataFrame([], STORED)
    newest = rows.groupBy("setting_id").agg(F.max(F.struct("last_modified", "last_modified_by", "role", "constraints")).alias("r"))
    of_each = ids.select("setting_id").distinct().join(newest, "setting_id", "left").select("setting_id", "r.*")
    return normalize_prompt(of_each, *defaults).select("setting_id", "role", "constraints", "last_modified", "last_modified_by")
