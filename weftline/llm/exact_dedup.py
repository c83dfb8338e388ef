"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

Texts count as equal when they are identical after deleting ASCII white space.
The index lives below one path, in generations: bucketed and sorted tables, one
for each batch, with a row for every digest of the batch, the row that stays,
the number of rows seen in the batch and whether the digest was new.  A batch
is reduced to its distinct digests (partial aggregation before the shuffle),
new digests are found by sort-merge anti-joins against the generations, which
need no shuffle of the index, and are appended as a further one.  A manifest
names the generations; it is replaced in one step, so a crash between writing
and committing leaves the index as it was.  Opening an index by its path goes
on where the last commit ended; ``compact`` merges the generations.

Defined cases: a null text counts as empty; a null doc_id ranks after every
other; rows that repeat doc_id and text share their decision (``deduplicate``
returns one of them); extra columns, whatever their names, pass through
``deduplicate`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Manifest, delete_path, join_groups, materialize, scratch_path, text_or_empty, unused

INDEX_SCHEMA = "digest string, keep_id long, keep_chars int, group_size long, is_new boolean"
#: Digests that a bucket of a fresh index holds, about (100 bytes each).
BUCKET_DIGESTS = 250_000
#: Generations of an index above which it is compacted.
MOST_GENERATIONS = 8


def text_digest(text):
    """SHA-256 (lowercase hex) of the text without ASCII white space."""
    return F.sha2(F.translate(text, ASCII_SPACE, "").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text_digest(text).alias("digest"), F.length(text).alias("chars"))


def keepers(digested: DataFrame) -> DataFrame:
    """One row per digest; the longest original, then the smallest doc_id, stays."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i")))
    return (
        digested.groupBy("digest")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "group_size")
    )


def buckets_for(rows: int) -> int:
    return max(8, -(-rows // BUCKET_DIGESTS))


class DigestIndex:
    """Generations of digests below ``path``; without a path, in scratch space.

    ``buckets`` holds for a fresh index only; one that exists keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.manifest = Manifest(spark, self.path)
        state = self.manifest.load() or {"buckets": buckets, "generations": []}
        self.buckets, self.names = state["buckets"], state["generations"]
        self.old: list[str] = []

    def _generation(self, name: str) -> DataFrame:
        # a catalog entry tells Spark of the buckets; the plan has them once it is resolved
        entry = f"weftline_digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {entry} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        found = self.spark.table(entry)
        found.schema  # resolves the plan
        self.spark.sql(f"DROP TABLE {entry}")
        return found

    def _write(self, rows: DataFrame) -> str:
        """A new generation, written but not committed; one task a bucket writes one file a bucket."""
        name, entry = f"digests-{uuid.uuid4().hex}", f"weftline_digests_{uuid.uuid4().hex}"
        (
            rows.select("digest", "keep_id", "keep_chars", "group_size", "is_new")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", f"{self.path}/{name}")
            .saveAsTable(entry)
        )
        self.spark.sql(f"DROP TABLE {entry}")
        return name

    def _commit(self, names: list[str]) -> None:
        self.manifest.commit({"buckets": self.buckets, "generations": names})
        self.names = names

    def read(self) -> DataFrame:
        """digest, keep_id, keep_chars, group_size: one row for each digest, with all rows seen."""
        if not self.names:
            return self.spark.createDataFrame([], INDEX_SCHEMA).drop("is_new")
        if len(self.names) == 1:
            return self._generation(self.names[0]).drop("is_new")
        # Not as bucketed tables: a union of these is taken to be bucketed itself, and gave a row for each generation.
        rows = self.spark.read.schema(INDEX_SCHEMA).parquet(*[f"{self.path}/{n}" for n in self.names])
        first = F.max(F.when(F.col("is_new"), F.struct("keep_id", "keep_chars")))
        return (
            rows.groupBy("digest")
            .agg(first.alias("b"), F.sum("group_size").alias("group_size"))
            .select("digest", F.col("b.keep_id").alias("keep_id"), F.col("b.keep_chars").alias("keep_chars"), "group_size")
        )

    def append(self, best: DataFrame) -> DataFrame:
        """Add the digests of a batch (one row each); returns those that the index didn't have."""
        if self.names:
            best = materialize(best, "batch-digests")
        new = best
        for n in self.names:
            known = self._generation(n).where("is_new").select("digest")
            new = new.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        rows = new.withColumn("is_new", F.lit(True))
        if self.names:  # of known digests, the rows seen now
            rows = materialize(rows, "new-digests")
            again = best.hint("merge").join(rows.select("digest").hint("merge"), "digest", "left_anti")
            rows = rows.unionByName(again.withColumn("is_new", F.lit(False)))
        name = self._write(rows)
        self._commit([*self.names, name])
        if len(self.names) > MOST_GENERATIONS:
            self.compact()
        return self._generation(name).where("is_new").drop("is_new")

    def compact(self) -> None:
        """Merge all generations into one."""
        name, old = self._write(self.read().withColumn("is_new", F.lit(True))), self.names
        self._commit([name])
        self.old += old

    def vacuum(self) -> None:
        """Delete merged generations; results that were not yet computed from them can't be afterwards."""
        for n in self.old:
            delete_path(self.spark, f"{self.path}/{n}")
        self.old = []


def decisions(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    With an index that already has digests, rows of known texts are dropped in
    favour of the historical row, and ``group_size`` counts all rows ever seen.
    """
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count()))
    digested = digests(docs)
    index.append(keepers(digested))
    known = index.read()
    total = known.agg(F.sum("group_size")).head()[0] or 0
    return join_groups(digested, known, ["digest"], "group_size", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one per distinct new text.

    New texts are found by sort-merge anti-join against the index and appended.
    """
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count()))
    new = index.append(keepers(digests(docs)))
    digest, chars, keep_id, keep_chars, size = unused(docs.columns, "digest", "chars", "keep_id", "keep_chars", "group_size")
    text = text_or_empty()
    marked = docs.withColumn(digest, text_digest(text)).withColumn(chars, F.length(text))
    new = new.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep_id), F.col("keep_chars").alias(keep_chars), F.col("group_size").alias(size))
    found = join_groups(marked, new, [digest], size, new.agg(F.sum(size)).head()[0] or 0)
    stays = F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(chars) == F.col(keep_chars))
    return found.where(stays).dropDuplicates([digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
