"""Deep pages of a sorted list, read from the ranges that hold them.

A top-k with an offset keeps all rows before the page in every task.  Here the
list is dealt once into ranges of its order, written with a count for each
range; a page is then looked up in the running sum of the counts, and only the
one or two ranges that hold it are read and sorted.

The order is that of ``listing.text_order``: a column as lower-case text, nulls
first going up and last going down, then the tie columns going up.  Ties are
part of the ranges, so a value that a third of the rows share is spread.

Defined cases: rows that agree in the order and all ties follow in any order;
an empty list has one empty page; numbers and sizes are clamped as in
``listing.clamped_page``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .listing import MOST_ROWS, text_order

PART = "_range"
#: Ranges of a list; their counts are what the driver holds.
RANGES = 200


def _order(column: str, ties: list[str], descending: bool) -> list[Column]:
    return [text_order(column, descending), *[F.col(t).asc_nulls_first() for t in ties]]


class PageIndex:
    """``build`` writes the ranges of a list, ``page`` reads one page of it."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, column: str, ties: list[str], descending: bool = False):
        """Opens what ``build`` wrote.  Counting the ranges reads no column of theirs, only footers."""
        self.spark, self.path = spark, path
        self.stored = StructType([*schema, StructField(PART, IntegerType())])
        self.order = _order(column, ties, descending)
        counts = {r[PART]: r["count"] for r in self._rows().groupBy(PART).count().collect()}  # at most as many as ranges
        self.ends = list(accumulate(counts.get(i, 0) for i in range(max(counts, default=-1) + 1)))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    @classmethod
    def build(cls, df: DataFrame, path: str, column: str, ties: list[str], descending: bool = False, ranges: int = RANGES) -> PageIndex:
        dealt = df.repartitionByRange(ranges, *_order(column, ties, descending)).withColumn(PART, F.spark_partition_id())
        dealt.write.partitionBy(PART).parquet(path)
        return cls(df.sparkSession, path, df.schema, column, ties, descending)

    def ranges_of(self, number: int, size: int) -> tuple[int, int, int, int]:
        """The page that is shown for ``number``, how many there are, and the first and last range that hold it."""
        total = self.ends[-1] if self.ends else 0
        pages = max(1, -(-total // size))
        number = min(max(1, number), pages)
        begin, end = (number - 1) * size, min(number * size, total)
        first = next((i for i, e in enumerate(self.ends) if e > begin), 0)
        last = next((i for i, e in enumerate(self.ends) if e >= end), first)
        return number, pages, first, max(first, last)

    def page(self, number: int = 1, size: int = 25) -> DataFrame:
        """The rows of a page with ``total``, ``page`` and ``pages``, like ``listing.clamped_page``."""
        size = min(MOST_ROWS, max(1, int(size or 25)))
        number, pages, first, last = self.ranges_of(int(number or 1), size)
        before = self.ends[first - 1] if first else 0
        rows = self._rows().where(F.col(PART).between(first, last)).drop(PART)
        got = rows.orderBy(*self.order).offset((number - 1) * size - before).limit(size)
        total = self.ends[-1] if self.ends else 0
        return got.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(number), "pages": F.lit(pages)})
