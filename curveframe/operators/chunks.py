"""Chunked ordering: per-dataset windows without a task per dataset.

One dataset may hold a large share of all rows, so no window or join on raw rows
may be keyed by the dataset alone. Rows are keyed by ``(dataset, chunk)`` with
``chunk = ordinal div CHUNK_ROWS``; whatever has to cross a chunk border travels
through a *chunk table* that has one row per chunk. That table is smaller than
the data by the chunk size, so its own window per dataset stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.numeric import finite_or_null
from curveframe.schema import DATASET_KEYS

CHUNK_ROWS = 1 << 20


def with_chunk(df: DataFrame, chunk_rows: int = CHUNK_ROWS, ordinal: str = "ordinal") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(ordinal) / F.lit(chunk_rows)).cast("bigint"))


def lag_by_chunk(
    df: DataFrame,
    value: str,
    alias: str,
    keys: Sequence[str] = DATASET_KEYS,
    ordinal: str = "ordinal",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``lag(value)`` per ``keys`` by ``ordinal``; the result keeps ``chunk``.

    The first row of a chunk takes the last value of the preceding chunk that
    has rows, whatever the gap between the two. Rows are shuffled once: the
    window and the chunk table read the same exchange, so hand in only the
    columns that are needed.
    """
    keys = list(keys)
    chunked = with_chunk(df, chunk_rows, ordinal).repartition(*keys, "chunk")
    last = chunked.groupBy(*keys, "chunk").agg(F.max_by(value, ordinal).alias("chunk_last"))
    border = last.select(
        *keys,
        "chunk",
        F.lag("chunk_last").over(Window.partitionBy(*keys).orderBy("chunk")).alias("carried"),
    )
    inside = Window.partitionBy(*keys, "chunk").orderBy(ordinal)
    return (
        chunked.withColumn("lagged", F.lag(value).over(inside))
        .withColumn("place", F.row_number().over(inside))
        .join(border, [*keys, "chunk"])
        .withColumn(
            alias, F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("lagged"))
        )
        .drop("lagged", "place", "carried")
    )


def chunk_table(
    df: DataFrame,
    keys: Sequence[str] = DATASET_KEYS,
    ordinal: str = "ordinal",
    index: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per chunk: its rows, the rows before it, and dataset-wide figures.

    With ``index`` it also carries the finite index extent of the chunk and of
    the dataset, and the dataset's count of finite index values.
    """
    keys = list(keys)
    aggregates = [F.count(F.lit(1)).alias("chunk_count")]
    if index is not None:
        finite = finite_or_null(index)
        aggregates += [
            F.count(finite).alias("chunk_finite"),
            F.min(finite).alias("chunk_minimum"),
            F.max(finite).alias("chunk_maximum"),
        ]
    chunks = with_chunk(df, chunk_rows, ordinal).groupBy(*keys, "chunk").agg(*aggregates)
    dataset = Window.partitionBy(*keys)
    before = dataset.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    columns: list[Column] = [
        F.coalesce(F.sum("chunk_count").over(before), F.lit(0)).alias("rows_before"),
        F.sum("chunk_count").over(dataset).alias("dataset_rows"),
    ]
    if index is not None:
        columns += [
            F.sum("chunk_finite").over(dataset).alias("dataset_finite"),
            F.min("chunk_minimum").over(dataset).alias("dataset_minimum"),
            F.max("chunk_maximum").over(dataset).alias("dataset_maximum"),
        ]
    return chunks.select("*", *columns)


def dense_ordinal(
    df: DataFrame,
    keys: Sequence[str] = DATASET_KEYS,
    ordinal: str = "ordinal",
    alias: str = "position",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Zero-based ``row_number`` per ``keys``, plus ``dataset_rows``."""
    keys = list(keys)
    chunks = chunk_table(df, keys, ordinal, chunk_rows=chunk_rows).select(
        *keys, "chunk", "rows_before", "dataset_rows"
    )
    inside = Window.partitionBy(*keys, "chunk").orderBy(ordinal)
    return (
        with_chunk(df, chunk_rows, ordinal)
        .withColumn("place", F.row_number().over(inside))
        .join(chunks, [*keys, "chunk"])
        .withColumn(alias, (F.col("rows_before") + F.col("place") - 1).cast("bigint"))
        .drop("place", "rows_before")
    )
