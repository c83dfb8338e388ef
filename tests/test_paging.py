"""Deep pages against a sorted list, and how much of it they read."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import listing as L
from weftline.operators.paging import PageIndex


@pytest.mark.parametrize("descending", [False, True])
def test_pages_agree_with_the_whole_list(spark, tmp_path, descending):
    """A third of the rows share a name, some have none; ids repeat."""
    name = F.when(F.col("id") % 3 == 0, "Same").when(F.col("id") % 10 > 0, F.concat(F.lit("N"), (F.col("id") % 97).cast("string")))
    df = spark.range(1003).select(name.alias("name"), (F.col("id") % 500).alias("id"), F.col("id").alias("row"))
    index = PageIndex.build(df, str(tmp_path / "p"), "name", ["id", "row"], descending, ranges=16)
    again = PageIndex(spark, str(tmp_path / "p"), df.schema, "name", ["id", "row"], descending)
    order = [L.text_order("name", descending), F.col("id"), F.col("row")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for number, size in ((1, 25), (17, 25), (41, 25), (1000, 25), (-3, 7), (30, 7), (4, 400)):
        rows = again.page(number, size).collect()
        shown = min(100, size)
        number = min(max(1, number), -(-1003 // shown))
        assert [(r["name"], r["id"], r["row"]) for r in rows] == whole[(number - 1) * shown : number * shown]
        assert {(r["total"], r["page"], r["pages"]) for r in rows} == {(1003, number, -(-1003 // shown))}
    # the shared name is dealt over several ranges, and a page reads at most two
    assert len(index.ends) > 10 and max(b - a for a, b in zip([0, *index.ends], index.ends, strict=False)) < 1003 / 5
    for number in range(1, 42):
        _, _, first, last = index.ranges_of(number, 25)
        assert last - first <= 1 or index.ends[last - 1] - index.ends[first] < 25
    plan = again.page(20, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "TakeOrderedAndProject" in plan


def test_short_and_empty_lists(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("A", 3)], "name string, id long")
    assert [r["id"] for r in PageIndex.build(df, str(tmp_path / "a"), "name", ["id"]).page().collect()] == [1, 3, 2]
    empty = PageIndex.build(df.limit(0), str(tmp_path / "b"), "name", ["id"])
    assert empty.page(5).collect() == [] and empty.ranges_of(5, 25)[:2] == (1, 1)
