"""Upserts, deletions and compaction of a keyed table against a dictionary, and what a crash leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.sources.keyed_table import KeyedTable

SCHEMA = "k string, v long, m map<string,string>"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, {"lang": "fr" if v and v % 3 == 0 else "en"}) for k, v in rows], SCHEMA)


def content(table):
    rows = table.read().collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["k"]: r["v"] for r in rows}


def written(path):
    return sum(f.stat().st_size for f in Path(path).glob("data/*/*/*.parquet"))


def test_changes_agree_with_a_dictionary(spark, tmp_path):
    path, rnd = str(tmp_path / "t"), random.Random(3)
    want = {None: 0, "": 1} | {f"k{i}": i for i in range(200)}
    table = KeyedTable.create(frame(spark, want.items()), path, "k", 8)
    for i in range(6):
        new = {rnd.choice([None, "", *(f"k{j}" for j in range(220))]): 1000 * i + j for j in range(12)}
        want |= new
        table = KeyedTable.open(spark, path).upsert(frame(spark, new.items()), compact_at=3)
        if i % 2:
            gone = [f"k{rnd.randrange(240)}" for _ in range(9)] + ([None] if i == 3 else [])
            want = {k: v for k, v in want.items() if k not in gone}
            table = table.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        assert content(table) == content(KeyedTable.open(spark, path)) == want
    table = table.delete_where(F.element_at("m", F.lit("lang")) == "fr")
    want = {k: v for k, v in want.items() if not (v and v % 3 == 0)}
    assert content(table) == want
    some = [None, "k5", "k7", "absent"]
    assert {r["k"]: r["v"] for r in table.lookup(spark.createDataFrame([(k,) for k in some], "k string")).collect()} == {k: want[k] for k in some if k in want}
    whole = table.compact()
    assert content(whole) == want and not any(whole.version.changes.values()) and whole.compact() is whole
    assert whole.vacuum() > 0 and content(KeyedTable.open(spark, path)) == want


def test_an_upsert_writes_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.create_map(F.lit("t"), F.sha2(F.col("id").cast("string"), 512)).alias("m"))
    table = KeyedTable.create(rows, path, "k", 8)
    before = written(path)
    table = table.upsert(rows.where("v % 100 = 0").withColumn("v", F.lit(-1).cast("long")))
    assert written(path) - before < before / 20
    assert table.read(F.col("v") == -1).count() == 200 and table.read().count() == 20000
    # a change of one key leaves the bases of the other buckets as they are, when compacted too
    one = table.compact().upsert(rows.where("v = 7").withColumn("v", F.lit(-2).cast("long")))
    assert sum(bool(c) for c in one.version.changes.values()) == 1
    assert len(set(one.version.base.items()) ^ set(one.compact().version.base.items())) == 2


def test_last_row_of_a_key_and_missing_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 7), ("b", 4, None)], "k string, v long, at long")
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", 4, F.col("at"))
    assert content(table) == {"a": 2, "b": 4}
    table = table.upsert(spark.createDataFrame([("b",)], "k string"))
    assert content(table) == {"a": 2, "b": None}
    with pytest.raises(ValueError, match="no columns"):
        table.upsert(spark.createDataFrame([("b", 1)], "k string, other long"))
    with pytest.raises(ValueError, match="there is a table"):
        KeyedTable.create(rows, str(tmp_path / "t"), "k")
    assert table.upsert(rows.limit(0)) is table and table.delete(spark.createDataFrame([("zz",)], "k string")) is table


def test_crashes_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, [("a", 1), ("b", 2)]), path, "k", 4)
    # a writer that died after its rows, and one that died within its manifest
    table._write(frame(spark, [("a", 9)]).withColumn("_gone", F.lit(False)), "change")
    torn = Path(path) / "versions" / "0000000002.json"
    torn.write_text(table.version.dumps()[:-20])
    again = KeyedTable.open(spark, path)
    assert again.version.number == 1 and content(again) == {"a": 1, "b": 2}
    new = again.upsert(frame(spark, [("b", 3)]))
    assert new.version.number == 3 and content(KeyedTable.open(spark, path)) == {"a": 1, "b": 3}
    with pytest.raises(RuntimeError, match="another writer"):
        again.upsert(frame(spark, [("c", 4)]))
    assert content(again) == {"a": 1, "b": 2} and content(KeyedTable.open(spark, path)) == {"a": 1, "b": 3}


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(frame(spark, []), path, "k", 4)
    assert content(table) == {} and content(table.upsert(frame(spark, [("a", 1)]))) == {"a": 1}
