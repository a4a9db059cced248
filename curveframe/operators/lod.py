"""Bounded level of detail: per curve and bucket the samples that shape a plot.

Samples stay where they are: each task reduces its rows to at most five samples
per curve and bucket, and only those travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveframe.functions.numeric import column, finite_or_null, is_finite
from curveframe.operators.chunks import CHUNK_ROWS, chunk_table, with_chunk
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS

SAMPLES_PER_BUCKET = 5


def buckets_per_curve(curves: int, point_budget: int = 8000, viewport_height: int = 1000) -> int:
    budget = min(point_budget, max(100, viewport_height * 2))
    return max(1, budget // curves // SAMPLES_PER_BUCKET)


def bucket_number(index: str | Column, low: Column, high: Column, buckets: int) -> Column:
    """Bucket of a finite index; an empty range has the single bucket 0."""
    share = (column(index) - low) / F.when(high - low > 0, high - low)
    position = F.floor(share * buckets).cast("int")
    return F.coalesce(F.greatest(F.least(position, F.lit(buckets - 1)), F.lit(0)), F.lit(0))


def in_range(index: str | Column, low: float, high: float) -> Column:
    """Inclusive range with the bounds in either order; null never matches."""
    return column(index).between(min(low, high), max(low, high))


def _picks(value: Column) -> Column:
    """First, last, first null, smallest and largest sample of a group, as one struct.

    Equal values keep the earliest sample: ordinals decide, reversed for the maximum.
    """
    value = finite_or_null(value)
    known = value.isNotNull()
    point = F.struct("ordinal", "index", value.alias("value"))
    by_value = F.struct(value.alias("value"), "ordinal", "index")
    by_value_reversed = F.struct(value.alias("value"), (-F.col("ordinal")).alias("reversed"), "index")
    return F.struct(
        F.min(point).alias("first"),
        F.max(point).alias("last"),
        F.min(F.when(~known, point)).alias("null_sample"),
        F.min(F.when(known, by_value)).alias("low"),
        F.max(F.when(known, by_value_reversed)).alias("high"),
    )


def _picked_samples(picks: DataFrame) -> DataFrame:
    """The distinct samples behind the ``picks`` struct; one in several roles comes once."""
    low, high = F.col("picks.low"), F.col("picks.high")
    lowest = F.when(low.isNotNull(), F.struct(low["ordinal"], low["index"], low["value"]))
    highest = F.when(
        high.isNotNull(),
        F.struct((-high["reversed"]).alias("ordinal"), high["index"], high["value"]),
    )
    unique = F.array_distinct(
        F.array_compact(
            F.array("picks.first", lowest, highest, "picks.null_sample", "picks.last")
        )
    )
    return picks.select(*CHANNEL_KEYS, "bucket", F.explode(unique).alias("sample")).select(
        *CHANNEL_KEYS, "bucket", "sample.*"
    )


def bucket_samples(bucketed: DataFrame) -> DataFrame:
    """First, smallest, largest, first null and last sample per curve and bucket."""
    return _picked_samples(
        bucketed.groupBy(*CHANNEL_KEYS, "bucket").agg(_picks(F.col("value")).alias("picks"))
    )


def wide_bucket_samples(bucketed: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``bucket_samples`` of a wide table: rows are grouped once for all curves."""
    picks = bucketed.groupBy(*DATASET_KEYS, "bucket").agg(
        *[_picks(F.col(channel)).alias(channel) for channel in channels]
    )
    return _picked_samples(
        picks.unpivot([*DATASET_KEYS, "bucket"], list(channels), "channel_id", "picks")
    )


def _in_view(df: DataFrame, low: float, high: float, buckets: int) -> DataFrame:
    low, high = float(min(low, high)), float(max(low, high))
    return df.where(in_range("index", low, high) & is_finite("index")).withColumn(
        "bucket", bucket_number("index", F.lit(low), F.lit(high), buckets)
    )


def visible_range(
    samples: DataFrame,
    index_minimum: float,
    index_maximum: float,
    curves: int,
    point_budget: int = 8000,
    viewport_height: int = 1000,
) -> DataFrame:
    """Level of detail of one index range; the range reaches the scan as a filter."""
    buckets = buckets_per_curve(curves, point_budget, viewport_height)
    return bucket_samples(_in_view(samples, index_minimum, index_maximum, buckets))


def wide_visible_range(
    wide: DataFrame,
    channels: Sequence[str],
    index_minimum: float,
    index_maximum: float,
    point_budget: int = 8000,
    viewport_height: int = 1000,
) -> DataFrame:
    """``visible_range`` of wide-table channels."""
    buckets = buckets_per_curve(len(channels), point_budget, viewport_height)
    return wide_bucket_samples(_in_view(wide, index_minimum, index_maximum, buckets), channels)


def with_extent_buckets(
    df: DataFrame, buckets: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Bucket every finite row over the full index extent of its own dataset.

    The extent arrives per chunk, so the join never gathers a dataset.
    """
    extents = chunk_table(df, index="index", chunk_rows=chunk_rows).select(
        *DATASET_KEYS, "chunk", "dataset_minimum", "dataset_maximum"
    )
    finite = with_chunk(df.where(is_finite("index")), chunk_rows)
    return (
        finite.join(extents, [*DATASET_KEYS, "chunk"])
        .withColumn(
            "bucket",
            bucket_number(
                "index", F.col("dataset_minimum"), F.col("dataset_maximum"), buckets
            ),
        )
        .drop("chunk", "dataset_minimum", "dataset_maximum")
    )


def ordered_for_plot(lod: DataFrame, curve_order: list[str]) -> DataFrame:
    """Curves in request order, samples in source order."""
    place = F.array_position(F.array(*[F.lit(curve) for curve in curve_order]), F.col("channel_id"))
    return lod.orderBy(*DATASET_KEYS, place, "ordinal")
