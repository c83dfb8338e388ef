"""A table with a key that takes upserts and deletions by writing the changes alone.

Rows are dealt into buckets by a hash of the key.  A change writes its own rows
as one more generation of the buckets that it touches; a deletion writes marks.
A read takes buckets without changes as they are, and joins the others to their
own changes, which are small.  Compaction writes one new base for each bucket
that has gathered changes and leaves the rest alone.

A commit is one manifest file under a number of its own, made only if no such
file exists: of two writers one fails and has changed nothing.  A writer that
dies before it leaves folders that no manifest names; a torn manifest is passed
over, and the next commit takes the number after it.  Readers keep the version
that they opened; old generations stay until ``vacuum``.

Defined cases: of several rows of a key in one change the last by ``order``
counts, ties by the whole row; null is a key like any other; deleting what
isn't there changes nothing; an empty change commits nothing; columns that the
table lacks are an error, columns that the change lacks are null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

BUCKET, GONE = "_bucket", "_gone"
#: Generations of changes of a bucket before ``upsert`` and ``delete`` compact it.
MOST_CHANGES = 8


@dataclass
class Version:
    """What a manifest says: for each bucket its base and the changes since, oldest first."""

    number: int
    key: str
    buckets: int
    schema: StructType
    base: dict[int, str] = field(default_factory=dict)
    changes: dict[int, list[str]] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.json(), "base": self.base, "changes": self.changes, "whole": True})

    @classmethod
    def loads(cls, number: int, text: str) -> Version | None:
        try:
            d = json.loads(text)
            if not d["whole"]:
                return None
            ints = lambda m: {int(k): v for k, v in m.items()}
            return cls(number, d["key"], d["buckets"], StructType.fromJson(json.loads(d["schema"])), ints(d["base"]), ints(d["changes"]))
        except (ValueError, KeyError, TypeError):
            return None


class KeyedTable:
    """``create`` makes one, ``open`` takes the newest whole version at the path."""

    def __init__(self, spark: SparkSession, path: str, version: Version):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64, order: Column | None = None) -> KeyedTable:
        """A table of ``rows``, the last of each key; a table must not be there yet."""
        spark = rows.sparkSession
        if _manifests(spark, path):
            raise ValueError(f"there is a table at {path}")
        table = cls(spark, path, Version(0, key, buckets, rows.schema))
        generation, touched = table._write(table._last(rows, order), "base")
        return table._commit({b: generation for b in touched}, {})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        for number in sorted(_manifests(spark, path), reverse=True):
            version = Version.loads(number, _read(spark, _manifest(path, number)))
            if version is not None:
                return cls(spark, path, version)
        raise ValueError(f"no table at {path}")

    def read(self, where: Column | None = None) -> DataFrame:
        """The rows of this version.  ``where`` may name any column; on a base it is pushed into the scan."""
        v = self.version
        dirty = {b for b, c in v.changes.items() if c}
        bases = self._generations({b: [g] for b, g in v.base.items()})
        columns = v.schema.names
        keep = (lambda df: df.where(where)) if where is not None else (lambda df: df)
        if not dirty:
            return keep(bases).select(*columns)
        changed = self._changed({b: v.changes[b] for b in dirty})
        clean = keep(bases.where(~F.col(BUCKET).isin(*sorted(dirty)))).select(*columns) if len(dirty) < v.buckets else None
        rest = keep(bases.where(F.col(BUCKET).isin(*sorted(dirty)))).select(*columns).alias("base")
        keys = changed.select(F.col(v.key).alias("_key"))
        rest = rest.join(keys, F.col(f"base.{v.key}").eqNullSafe(F.col("_key")), "left_anti")
        out = rest.unionByName(keep(changed.where(~F.col(GONE))).select(*columns))
        return out if clean is None else clean.unionByName(out)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys``; only the buckets of these keys are read if they are few."""
        v = self.version
        wanted = keys.select(F.col(v.key).cast(v.schema[v.key].dataType).alias("_key")).distinct()
        hit = {r[0] for r in wanted.select(_bucket(F.col("_key"), v.buckets).alias("b")).distinct().collect()}  # at most ``buckets``
        part = KeyedTable(self.spark, self.path, Version(v.number, v.key, v.buckets, v.schema, _only(v.base, hit), _only(v.changes, hit)))
        found = part.read().alias("t")
        return found.join(wanted, F.col(f"t.{v.key}").eqNullSafe(F.col("_key")), "left_semi")

    def upsert(self, rows: DataFrame, order: Column | None = None, compact_at: int = MOST_CHANGES) -> KeyedTable:
        """The next version, with ``rows`` in place of those of the same keys."""
        unknown = set(rows.columns) - set(self.version.schema.names)
        if order is None and unknown:
            raise ValueError(f"the table has no columns {sorted(unknown)}")
        return self._change(self._last(rows, order).withColumn(GONE, F.lit(False)), compact_at)

    def delete(self, keys: DataFrame, compact_at: int = MOST_CHANGES) -> KeyedTable:
        """The next version, without the rows of these keys."""
        v = self.version
        there = self.lookup(keys).select(v.key)
        marks = there.select(*[F.col(f.name) if f.name == v.key else F.lit(None).cast(f.dataType).alias(f.name) for f in v.schema])
        return self._change(marks.withColumn(GONE, F.lit(True)), compact_at)

    def delete_where(self, condition: Column, compact_at: int = MOST_CHANGES) -> KeyedTable:
        """The next version, without rows for which the condition is true (null is not)."""
        return self.delete(self.read(F.coalesce(condition, F.lit(False))).select(self.version.key), compact_at)

    def compact(self, least: int = 1) -> KeyedTable:
        """The next version, where buckets of ``least`` or more changes have one base again."""
        v = self.version
        full = {b for b, c in v.changes.items() if len(c) >= least}
        if not full:
            return self
        names = [*v.schema.names, GONE]
        old = self._generations({b: [g] for b, g in _only(v.base, full).items()}).withColumns({GONE: F.lit(False), "_place": F.lit(-1)})
        rows = old.select(*names, BUCKET, "_place").unionByName(self._changes(_only(v.changes, full)).select(*names, BUCKET, "_place"))
        # a key has one row in the base and one a change, so nothing is hot; dealt by bucket, they are grouped and written without another shuffle
        best = rows.repartition(BUCKET).groupBy(BUCKET, F.col(v.key).alias("_k")).agg(F.max_by(F.struct(*names), "_place").alias("r"))
        generation, touched = self._write(best.where(~F.col(f"r.{GONE}")).select(*[F.col("r")[n].alias(n) for n in v.schema.names], BUCKET), "base")
        base = {b: g for b, g in v.base.items() if b not in full} | {b: generation for b in touched}
        return self._commit(base, {b: c for b, c in v.changes.items() if b not in full})

    def vacuum(self) -> int:
        """Remove generations that this version doesn't name; how many.  Readers of older versions must be done."""
        named = set(self.version.base.values()) | {g for c in self.version.changes.values() for g in c}
        fs, folder = _fs(self.spark, f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
        for p in old:
            fs.delete(p, True)
        return len(old)

    def _change(self, rows: DataFrame, compact_at: int) -> KeyedTable:
        generation, touched = self._write(rows, "change")
        if not touched:
            return self
        v = self.version
        table = self._commit(v.base, v.changes | {b: [*v.changes.get(b, []), generation] for b in touched})
        return table.compact(compact_at)

    def _last(self, rows: DataFrame, order: Column | None) -> DataFrame:
        names = self.version.schema.names
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.version.schema]
        # maps can't be compared, so ties go by the hash of the row
        at = F.struct(*([order] if order is not None else []), F.xxhash64(*[F.to_json(F.struct(F.col(n))) for n in names if n in rows.columns]))
        whole = rows.select(*cast, at.alias("_at"))
        best = whole.groupBy(F.col(self.version.key).alias("_k")).agg(F.max_by(F.struct(*names), "_at").alias("r"))
        return best.select("r.*")

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, set[int]]:
        generation = f"{kind}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/{generation}"
        if BUCKET not in rows.columns:
            rows = rows.withColumn(BUCKET, _bucket(F.col(self.version.key), self.version.buckets)).repartition(BUCKET)
        rows.sortWithinPartitions(BUCKET, self.version.key).write.partitionBy(BUCKET).parquet(folder)
        fs, p = _fs(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return generation, {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, base: dict[int, str], changes: dict[int, list[str]]) -> KeyedTable:
        v = self.version
        # torn manifests keep their numbers; a whole one above ours is another writer's
        taken = [n for n in _manifests(self.spark, self.path) if n > v.number]
        if any(Version.loads(n, _read(self.spark, _manifest(self.path, n))) for n in taken):
            raise RuntimeError(f"another writer committed to {self.path} after version {v.number}")
        new = Version(max([v.number, *taken]) + 1, v.key, v.buckets, v.schema, base, changes)
        fs, p = _fs(self.spark, _manifest(self.path, new.number))
        stream = fs.create(p, False)
        try:
            stream.write(new.dumps().encode())
        finally:
            stream.close()
        return KeyedTable(self.spark, self.path, new)

    def _generations(self, of: dict[int, list[str]], extra: tuple[StructField, ...] = ()) -> DataFrame:
        """Rows of the generations ``of`` each bucket, with bucket and generation."""
        schema = StructType([*self.version.schema, *extra, StructField(BUCKET, IntegerType())])
        by: dict[str, list[int]] = {}
        for b, generations in of.items():
            for g in generations:
                by.setdefault(g, []).append(b)
        out = None
        for g, buckets in by.items():
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{g}").where(F.col(BUCKET).isin(*buckets)).withColumn("_generation", F.lit(g))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], StructType([*schema, StructField("_generation", StringType())]))

    def _changes(self, changes: dict[int, list[str]]) -> DataFrame:
        """All rows of the changes, with their ``_place`` in the order of commits."""
        # commits follow each other, so the lists of all buckets are parts of one order
        order = {g: i for i, g in enumerate(_merged(changes.values()))}
        place = F.create_map(*[F.lit(x) for g, i in order.items() for x in (g, i)])
        return self._generations(changes, (StructField(GONE, BooleanType()),)).withColumn("_place", place[F.col("_generation")])

    def _changed(self, changes: dict[int, list[str]]) -> DataFrame:
        """The newest change of each key."""
        names = [*self.version.schema.names, GONE]
        best = self._changes(changes).groupBy(F.col(self.version.key).alias("_k")).agg(F.max_by(F.struct(*names), "_place").alias("r"))
        return best.select("r.*")


def _merged(lists) -> list[str]:
    """One order in which every list keeps its own."""
    out: list[str] = []
    rest = [list(x) for x in lists]
    while rest := [x for x in rest if x]:
        tails = {g for x in rest for g in x[1:]}
        head = next(x[0] for x in rest if x[0] not in tails)
        out.append(head)
        rest = [x[1:] if x[0] == head else x for x in rest]
    return out


def _only(of: dict, buckets: set[int]) -> dict:
    return {b: x for b, x in of.items() if b in buckets}


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/versions/{number:010d}.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path.rstrip('/')}/versions")
    return [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")] if fs.exists(p) else []


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode(errors="replace")
    finally:
        stream.close()
