"""Cursor look-up: the rows nearest an index value, and the curve value there.

One cursor is a top-k over the dataset. A batch of cursors is merged with the index
axis alone (``asof``); only the rows found are then fetched with their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.numeric import (
    column,
    cursor_tolerance,
    finite_or_null,
    interpolate,
    within,
)
from curveframe.operators.asof import nearest
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS, NEAREST_ROWS

def nearest_rows_of_one(dataset: DataFrame, query: float, rows: int = NEAREST_ROWS) -> DataFrame:
    """The rows of one dataset nearest a query index, ties by ordinal."""
    return (
        dataset.where(F.col("index").isNotNull())
        .orderBy(F.abs(F.col("index") - F.lit(query)), "ordinal")
        .limit(rows)
    )


def nearest_rows(dataset: DataFrame, cursors: DataFrame, rows: int = NEAREST_ROWS) -> DataFrame:
    """The nearest rows of every cursor ``(document_id, dataset_id, query)``.

    ``place`` counts from 1 by distance, ties by ordinal; other columns of
    ``dataset`` are carried along.
    """
    near = nearest(dataset, cursors, rows).select(*DATASET_KEYS, "ordinal", "query", "place")
    return dataset.join(near, [*DATASET_KEYS, "ordinal"])


def resolve_cursor(near: DataFrame) -> DataFrame:
    """Curve value at each cursor from its nearest rows (``channel_id``, ``value``).

    A sample within tolerance is exact; else the samples around the cursor are
    joined by a line; else the nearest sample counts. Equal index values around
    the cursor are decided by the value.
    """
    index, query = F.col("index"), F.col("query")
    value = finite_or_null("value")
    point = F.struct(index.alias("index"), value.alias("value"))
    usable = value.isNotNull()

    def nearest_where(condition: Column) -> Column:
        return F.min_by(point, F.when(usable & condition, F.col("place")))

    picked = near.groupBy(*DATASET_KEYS, "query", "channel_id").agg(
        nearest_where(within(index, query, cursor_tolerance(query))).alias("exact"),
        nearest_where(F.lit(True)).alias("nearest"),
        F.max(F.when(usable & (index < query), point)).alias("below"),
        F.min(F.when(usable & (index > query) & ~F.isnan(index), point)).alias("above"),
    )
    exact = F.col("exact").isNotNull()
    between = F.col("below").isNotNull() & F.col("above").isNotNull()
    line = interpolate(
        query, F.col("below.index"), F.col("below.value"), F.col("above.index"), F.col("above.value")
    )
    return picked.select(
        *DATASET_KEYS,
        "query",
        "channel_id",
        F.when(exact, F.col("exact.value"))
        .when(between, line)
        .otherwise(F.col("nearest.value"))
        .alias("value"),
        F.when(exact, F.col("exact.index"))
        .when(between, query)
        .otherwise(F.col("nearest.index"))
        .alias("sample_index"),
        F.when(exact, "exact")
        .when(between, "interpolated")
        .when(F.col("nearest").isNotNull(), "nearest")
        .otherwise("no_data")
        .alias("status"),
    )


def cursor_values(
    wide: DataFrame, channels: Sequence[str], cursors: DataFrame
) -> DataFrame:
    """Values of wide-table channels at a batch of cursors."""
    near = nearest_rows(wide.select(*DATASET_KEYS, "ordinal", "index", *channels), cursors)
    typed = near.select(
        *DATASET_KEYS,
        "query",
        "place",
        "index",
        *[F.col(name).cast("double").alias(name) for name in channels],
    )
    return resolve_cursor(
        typed.unpivot(
            [*DATASET_KEYS, "query", "place", "index"], list(channels), "channel_id", "value"
        )
    )


def cursor_values_of_samples(axis: DataFrame, samples: DataFrame, cursors: DataFrame) -> DataFrame:
    """Values of long samples at a batch of cursors, ranked on the index axis."""
    near = nearest(axis, cursors, NEAREST_ROWS)
    cells = samples.select(*DATASET_KEYS, "ordinal", "channel_id", "value")
    return resolve_cursor(near.join(cells, [*DATASET_KEYS, "ordinal"]))


def nearest_values(samples: DataFrame, cursors: DataFrame) -> DataFrame:
    """Value of the nearest non-null sample per curve, first on ties."""
    known = samples.where(column("value").isNotNull())
    of_curves = known.select(*CHANNEL_KEYS).distinct().join(cursors.select(*DATASET_KEYS, "query"), DATASET_KEYS)
    return nearest(known, of_curves, 1, CHANNEL_KEYS, ["value"]).select(
        *DATASET_KEYS, "query", "channel_id", "index", "value"
    )
