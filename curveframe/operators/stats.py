"""Curve, array and index statistics; even sampling; reshaping.

All statistics are plain partial aggregates: a task sends one row per group it
saw, so a dataset with most of the rows costs no more than its share of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.numeric import finite_or_null, is_finite, try_cast
from curveframe.functions.text import is_empty_text
from curveframe.operators.chunks import CHUNK_ROWS, dense_ordinal, lag_by_chunk
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS


def _value_statistics(value: str) -> list[Column]:
    finite = finite_or_null(value)
    return [
        F.min(finite).alias("minimum"),
        F.max(finite).alias("maximum"),
        F.count(F.lit(1)).alias("sample_count"),
        (F.count(F.lit(1)) - F.count(finite)).alias("null_count"),
        F.count_if(F.col(value).isNotNull() & ~is_finite(value)).alias("invalid_count"),
    ]


def curve_statistics(samples: DataFrame) -> DataFrame:
    """Extremes over finite values, non-finite as nulls, and non-null non-finite count."""
    return samples.groupBy(*CHANNEL_KEYS).agg(*_value_statistics("value"))


def wide_curve_statistics(
    wide: DataFrame, channels: Sequence[str], keys: Sequence[str] = DATASET_KEYS
) -> DataFrame:
    """``curve_statistics`` of a wide table: every channel in one pass, no row expansion."""
    aggregates = []
    for channel in channels:
        aggregates.append(F.struct(*_value_statistics(channel)).alias(channel))
    summary = wide.groupBy(*keys).agg(*aggregates)
    return summary.unpivot(list(keys), list(channels), "channel_id", "figures").select(
        *keys, "channel_id", "figures.*"
    )


def text_statistics(samples: DataFrame) -> DataFrame:
    """Count of empty text cells per channel."""
    return samples.groupBy(*CHANNEL_KEYS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(is_empty_text("text_value")).alias("null_count"),
    )


def castable_channels(cells: DataFrame, raw: str = "raw") -> DataFrame:
    """A channel is numeric only if every non-null cell parses as a number."""
    bad = F.col(raw).isNotNull() & try_cast(F.col(raw), "double").isNull()
    return cells.groupBy(*CHANNEL_KEYS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(bad).alias("text_count"),
        (F.count_if(bad) == 0).alias("is_numeric"),
    )


def index_extent(axis: DataFrame) -> DataFrame:
    finite = finite_or_null("index")
    return axis.groupBy(*DATASET_KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(finite).alias("finite_count"),
        F.min(finite).alias("index_minimum"),
        F.max(finite).alias("index_maximum"),
    )


def array_statistics(array_samples: DataFrame) -> DataFrame:
    """Extremes over all finite elements; rows and elements that are not finite."""
    per_row = array_samples.select(
        *CHANNEL_KEYS,
        "ordinal",
        "shape",
        F.size("values").alias("elements"),
        F.filter("values", is_finite).alias("finite"),
    )
    return per_row.groupBy(*CHANNEL_KEYS).agg(
        F.min(F.array_min("finite")).alias("minimum"),
        F.max(F.array_max("finite")).alias("maximum"),
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.size("finite") < F.col("elements")).alias("null_count"),
        F.sum(F.col("elements") - F.size("finite")).alias("null_element_count"),
    )


def sample_shapes(array_samples: DataFrame) -> DataFrame:
    """Shape of the first list-valued cell of each channel."""
    size = F.when(F.col("values").isNotNull(), F.col("ordinal"))
    dims = F.to_json("shape")
    return (
        array_samples.groupBy(*CHANNEL_KEYS)
        .agg(F.min_by(dims, size).alias("dims"))
        .select(*CHANNEL_KEYS, F.from_json("dims", "array<int>").alias("sample_shape"))
    )


def candidate_quality(axis: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Share of finite index values and of steps in the dominant direction.

    Steps run over the finite subsequence; fewer than two finite values score 0.
    """
    totals = axis.groupBy(*DATASET_KEYS).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(is_finite("index")).alias("finite_count")
    )
    steps = lag_by_chunk(
        axis.where(is_finite("index")).select(*DATASET_KEYS, "ordinal", "index"),
        "index",
        "previous",
        chunk_rows=chunk_rows,
    ).where(F.col("previous").isNotNull())
    delta = F.col("index") - F.col("previous")
    directions = steps.groupBy(*DATASET_KEYS).agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count_if(delta >= 0).alias("rising"),
        F.count_if(delta <= 0).alias("falling"),
    )
    dominant = F.greatest("rising", "falling").cast("double") / F.col("step_count")
    return totals.join(directions, DATASET_KEYS, "left").select(
        *DATASET_KEYS,
        "row_count",
        "finite_count",
        (F.col("finite_count").cast("double") / F.col("row_count")).alias("valid_ratio"),
        F.when(F.col("finite_count") >= 2, dominant).otherwise(F.lit(0.0)).alias("monotonic_ratio"),
    )


def even_positions(position: Column, rows: Column, points: int) -> Column:
    """Whether a zero-based position is one of ``points`` evenly spaced ones.

    Position p is kept when p = trunc(k * step) for some k below points-1, with
    step = (rows-1)/(points-1); the last position is always kept.
    """
    if points == 1:
        return position == 0
    step = (rows - 1).cast("double") / F.lit(float(points - 1))
    guess = F.floor(position / step).cast("bigint")
    hit = F.lit(False)
    for offset in (-1, 0, 1):
        k = guess + offset
        hit = hit | (
            (k >= 0) & (k < points - 1) & (F.floor(k.cast("double") * step).cast("bigint") == position)
        )
    return (rows <= points) | hit | (position == rows - 1)


def even_rows(axis: DataFrame, points: int, chunk_rows: int = CHUNK_ROWS, dense: bool = False) -> DataFrame:
    """(dataset, ordinal, position) of at most ``points`` evenly spaced rows per dataset.

    With ``dense`` ordinals (0, 1, 2, ... as ingest writes them) the rows follow from the
    number of rows alone; else the index axis is numbered, once for all curves.
    """
    if not dense:
        numbered = dense_ordinal(axis.select(*DATASET_KEYS, "ordinal"), chunk_rows=chunk_rows)
        kept = numbered.where(even_positions(F.col("position"), F.col("dataset_rows"), points))
        return kept.select(*DATASET_KEYS, "ordinal", "position")
    rows = F.col("rows")
    step = (rows - 1).cast("double") / F.lit(float(max(points - 1, 1)))
    places = F.sequence(F.lit(0).cast("bigint"), F.least(rows, F.lit(points)) - 1)
    spaced = F.transform(places, lambda k: F.floor(k.cast("double") * step).cast("bigint"))
    chosen = F.when(rows <= points, places).otherwise(
        F.array_union(F.slice(spaced, F.lit(1), F.lit(max(points - 1, 1))), F.array(rows - 1) if points > 1 else F.array().cast("array<bigint>"))
    )
    counted = axis.groupBy(*DATASET_KEYS).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(*DATASET_KEYS, F.explode(chosen).alias("ordinal")).withColumn("position", F.col("ordinal"))


def even_sample(
    axis: DataFrame, samples: DataFrame, points: int, chunk_rows: int = CHUNK_ROWS, dense: bool = False
) -> DataFrame:
    """Samples of at most ``points`` evenly spaced rows of the axis, as preview rows.

    Rows without a finite index drop out after the choice, as they would in a
    preview; values that are not finite become null.
    """
    wanted = even_rows(axis, points, chunk_rows, dense)
    return (
        samples.where(is_finite("index"))
        .join(wanted, [*DATASET_KEYS, "ordinal"])
        .select(*CHANNEL_KEYS, "position", F.col("index").alias("index_value"), finite_or_null("value").alias("value"))
    )


def preview_samples(axis: DataFrame, samples: DataFrame, points: int) -> DataFrame:
    """Preview rows of ingested samples, numbered per curve.

    A curve has at most ``points`` of them, so numbering them is bounded work.
    """
    order = Window.partitionBy(*CHANNEL_KEYS).orderBy("position")
    return even_sample(axis, samples, points, dense=True).select(
        *CHANNEL_KEYS, (F.row_number().over(order) - 1).alias("ordinal"), "index_value", "value"
    )


def unpivot_channels(
    wide: DataFrame, channels: Sequence[str], carried: Sequence[str] = ("ordinal", "index")
) -> DataFrame:
    """Wide to long; every channel is read as double."""
    ids = [*DATASET_KEYS, *carried]
    typed = wide.select(*ids, *[F.col(name).cast("double").alias(name) for name in channels])
    return typed.unpivot(ids, list(channels), "channel_id", "value")


def pivot_channels(samples: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long to wide, one column per requested channel in request order."""
    wanted = samples.where(F.col("channel_id").isin(*channels))
    return (
        wanted.groupBy(*DATASET_KEYS, "ordinal", "index")
        .pivot("channel_id", list(channels))
        .agg(F.first("value"))
    )
