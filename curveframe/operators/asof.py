"""Rows nearest a value on either side, by range partitions with carried borders.

Rows and cursors are dealt to ranges of (keys, index) that hold about equally many of
them, whatever the index looks like: an outlier, a block of ties or one dataset with a
third of all rows only changes where ranges end. Within a range each row takes the last
cursor at or before it; where a range has none so far, the last cursor of the ranges
before it is carried in through a table with one row per range. Rows between two
cursors then compete for the few places next to either one, most of them within their
own task. What is left is bounded by the cursors, and is ranked outwards from each one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.numeric import INFINITY, is_finite
from curveframe.schema import DATASET_KEYS
from curveframe.session import cut_lineage

SLOT = "_slot"


def _between_cursors(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``cursor``, the last query at or before them; null before the first."""
    empty = {name: F.lit(None).cast(rows.schema[name].dataType) for name in rows.columns if name not in (*keys, "index")}
    line = rows.withColumn("query", F.lit(None).cast("double")).unionByName(
        marks.select(*keys, F.col("query").alias("index"), "query").withColumns(empty)
    )
    # A cursor stands before the rows at its own index.
    order = [F.col("index").asc(), F.col("ordinal").asc_nulls_first()]
    # Kept, as another run of the plan might cut other ranges.
    ranged = cut_lineage(line.repartitionByRange(*keys, *order).withColumn("span", F.spark_partition_id()))
    carried = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    borders = ranged.groupBy(*keys, "span").agg(F.max("query").alias("last")).select(
        *keys, "span", F.max("last").over(carried).alias("border")
    )
    inside = Window.partitionBy(*keys, "span").orderBy(*order)
    seen = F.last("query", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranged.withColumn("cursor", seen)
        .where(F.col("query").isNull())
        .join(borders, [*keys, "span"])
        .withColumn("cursor", F.coalesce("cursor", "border"))
        .drop("query", "span", "border")
    )


def _ends_of_gaps(rows: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """The ``count`` rows next to the lower and to the upper cursor of each gap, with their sort key.

    The key grows away from the cursor: upwards it is the index, downwards its opposite, where
    what sorts above all numbers comes first.
    """
    opposite = F.when(F.isnan("index"), F.lit(-INFINITY)).otherwise(-F.col("index"))

    def end(upwards: bool) -> DataFrame:
        keyed = rows.withColumn("upwards", F.lit(upwards)).withColumn("away", F.col("index") if upwards else opposite)
        place = F.row_number().over(Window.partitionBy(*keys, "cursor").orderBy("away", "ordinal"))
        return keyed.withColumn("place", place).where(F.col("place") <= count)

    return cut_lineage(end(True).unionByName(end(False)).drop("place"))


def _outwards(ends: DataFrame, marks: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """For each query its ``count`` nearest rows on either side.

    Seen from a query, rows at or above it are in its own and later gaps, the others in
    earlier ones. Both sides are counted outwards from the far end of the other.
    """
    side = [*keys, "upwards"]
    sizes = ends.groupBy(*side, "cursor").agg(F.count(F.lit(1)).alias("size"))
    both_ways = marks.select(*keys, "query", F.col("query").alias("cursor"), F.explode(F.array(F.lit(True), F.lit(False))).alias("upwards"))
    gaps = sizes.join(both_ways, [*side, "cursor"], "full").withColumn("size", F.coalesce("size", F.lit(0)))
    lowest = F.coalesce("cursor", F.lit(-INFINITY))
    order = Window.partitionBy(*side).orderBy(F.when(F.col("upwards"), lowest).otherwise(-lowest))
    through = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = F.col("through") - F.when(F.col("upwards"), F.col("size")).otherwise(0)
    # A query asks for blocks of ``count`` places, not for each place, and for none past the last row.
    block = lambda place: F.floor((place - 1) / F.lit(count)).cast("bigint")
    final = F.least(passed + count, F.col("total"))
    wanted = (
        gaps.withColumn("through", through)
        .withColumn("total", F.sum("size").over(Window.partitionBy(*side)))
        .where(F.col("query").isNotNull() & (F.col("total") > passed))
        .select(*side, "query", passed.alias("passed"), F.explode(F.sequence(block(passed + 1), block(final))).alias("block"))
    )
    ranked = ends.withColumn("place", F.row_number().over(Window.partitionBy(*side).orderBy("away", "ordinal")))
    return (
        wanted.join(ranked.drop("cursor", "away").withColumn("block", block(F.col("place"))), [*side, "block"])
        .where((F.col("place") > F.col("passed")) & (F.col("place") <= F.col("passed") + count))
        .drop("place", "passed", "block", "upwards")
    )


def nearest(
    rows: DataFrame,
    cursors: DataFrame,
    count: int,
    keys: Sequence[str] = DATASET_KEYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``count`` rows nearest each cursor: (keys, query, place, ordinal, index, carried columns).

    ``place`` counts from 1 by distance, ties by ordinal, which must tell the rows of a
    key apart. Rows that differ by less than rounding at the distance of a far cursor are
    told apart by their index. Rows without an index and cursors that are not finite are
    left out.
    """
    # Keys that begin alike are slow to sort; their hash, put first, tells most of them apart.
    rows, cursors = (side.withColumn(SLOT, F.xxhash64(*keys)) for side in (rows, cursors))
    keys = [SLOT, *keys]
    marks = cursors.where(is_finite("query")).select(*keys, F.col("query").cast("double").alias("query")).distinct()
    marks = cut_lineage(marks)
    known = rows.where(F.col("index").isNotNull()).select(*keys, "index", "ordinal", *carry)
    placed = _between_cursors(known.join(marks.select(*keys).distinct(), keys, "left_semi"), marks, keys)
    sides = _outwards(_ends_of_gaps(placed, count, keys), marks, count, keys)
    by_distance = Window.partitionBy(*keys, "query").orderBy(F.abs(F.col("index") - F.col("query")), "ordinal")
    return sides.withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= count).drop(SLOT)
