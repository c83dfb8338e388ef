"""Searched, sorted and paged lists, and lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url

MOST_ROWS, MOST_SEARCH = 100, 200


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose joined columns hold the text, whatever its case."""
    needle = (text or "").strip().lower()[:MOST_SEARCH]
    if not needle:
        return df
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.where(F.contains(hay, F.lit(needle)))


def text_order(column: str, descending: bool) -> Column:
    """Everything is compared as lower-case text; nulls come first going up, last going down."""
    key = F.lower(F.col(column).cast("string"))
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page; numbers from 1, sizes from 1 to 100.  A top-k with an offset, never a full sort."""
    number, size = max(1, int(number or 1)), min(MOST_ROWS, max(1, int(size or 25)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def clamped_page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """As ``page``, but a number past the end gives the last page; totals are columns."""
    size = min(MOST_ROWS, max(1, size))
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    got = page(df, order, number, size)
    return got.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(number), "pages": F.lit(pages)})


def last_written(df: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert semantics: the newest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(version)).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, column by column where not null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, at: Column) -> DataFrame:
    """The new snapshot with tombstones: keys that are gone keep their rows, marked with the time.

    Rows that repeat a key stay as they are and are never paired; what a row of
    ``now`` leaves null comes from ``before``, the greatest value of its key.
    """
    others = [c for c in now.columns if c not in (key, "status", "tombstoned_at")]
    old = before.groupBy(F.col(key).alias("__k")).agg(*[F.max(c).alias(f"__{i}") for i, c in enumerate(others)], F.count(F.lit(1)).alias("__n"))
    kept = now.join(old, F.col(key).eqNullSafe(F.col("__k")), "left").select(
        key, "status", *[F.coalesce(F.col(c), F.col(f"__{i}")).alias(c) for i, c in enumerate(others)], F.when(F.lit(False), at).alias("tombstoned_at")
    )
    keys = now.select(F.col(key).alias("__k")).distinct()
    gone = before.join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return kept.unionByName(gone.select(key, F.lit("tombstoned").alias("status"), *others, at.alias("tombstoned_at")))


def progress(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Counts by status and the state that follows: no pending and some indexed is ready."""
    count = lambda s: F.count_if(F.col(status) == s)
    c = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        count("pending").alias("pending"),
        count("indexed").alias("indexed"),
        count("failed").alias("failed"),
    )
    state = F.when((F.col("pending") == 0) & (F.col("indexed") > 0), "ready").when(F.col("indexed") > 0, "partially_ready").otherwise("ingesting")
    return c.withColumn("processed", F.col("total") - F.col("pending")).withColumn("state", state)


def find_by_seed_url(registry: DataFrame, wanted: DataFrame, order: str = "created_at") -> DataFrame:
    """wanted_url, context_id: the first entry, by ``order`` and then id, whose seed URL is the wanted one, or null.

    URLs are compared normalised; entries without one are never found.  The
    registry has one row a URL left before the join.
    """
    usable = registry.where(F.trim(F.coalesce("seed_url", F.lit(""))) != "")
    first = usable.groupBy(normalize_url(F.trim("seed_url")).alias("key")).agg(F.min(F.struct(F.col(order).alias("at"), "context_id"))["context_id"].alias("context_id"))
    asked = wanted.select("wanted_url", normalize_url(F.trim("wanted_url")).alias("key"))
    return asked.join(first, "key", "left").select("wanted_url", "context_id")
