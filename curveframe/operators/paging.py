"""Deep pages of sorted rows by an offset table over range partitions.

Rows are sorted into ranges of (keys, order) of about equal size and written with their
line number in the range. One row per range and key tells how many rows come before it,
so a page reads the ranges it touches, however deep it lies and whatever share of
the rows its key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveframe.session import cut_lineage


class SortedPages:
    """Sorted rows, kept once for any number of pages."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> None:
        self.keys = list(keys)
        count = [ranges] if ranges else []
        sorted_ = rows.repartitionByRange(*count, *keys, *order).sortWithinPartitions(*keys, *order)
        self.rows = cut_lineage(
            sorted_.withColumn("span", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
        )
        spans = self.rows.groupBy(*keys, "span").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("size"))
        whole = Window.partitionBy(*keys)
        before = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = cut_lineage(
            spans.select(
                *keys,
                "span",
                "first_line",
                "size",
                F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
                F.sum("size").over(whole).alias("total"),
            )
        )

    def page(self, start: int, end: int) -> DataFrame:
        """Rows ``start`` to ``end`` (exclusive) of every key, with ``place`` from 1 and the key's ``total``."""
        touched = self.offsets.where((F.col("before") < end) & (F.col("before") + F.col("size") > start))
        place = F.col("before") + F.col("line") - F.col("first_line") + 1
        return (
            self.rows.join(touched.drop("size"), [*self.keys, "span"])
            .withColumn("place", place)
            .where((F.col("place") > start) & (F.col("place") <= end))
            .drop("span", "line", "first_line", "before")
        )
