"""Row pages and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.operators.chunks import CHUNK_ROWS, chunk_table, with_chunk
from curveframe.operators.stats import pivot_channels
from curveframe.schema import DATASET_KEYS, DEFAULT_PAGE_CURVES


def optional_range(low: float | None, high: float | None, index: str = "index") -> Column:
    """Range with either side open; reversed bounds are swapped."""
    if low is not None and high is not None and low > high:
        low, high = high, low
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(index) >= F.lit(low))
    if high is not None:
        condition = condition & (F.col(index) <= F.lit(high))
    return condition


def page_rows(
    rows: DataFrame,
    page: int,
    page_size: int,
    index_minimum: float | None = None,
    index_maximum: float | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One page of every dataset by ordinal, after the optional range filter.

    Row counts per chunk tell which chunks the page touches; only their rows are
    numbered, so a deep page costs the same as the first.
    """
    kept = rows.where(optional_range(index_minimum, index_maximum))
    start, end = page * page_size, (page + 1) * page_size
    touched = (
        chunk_table(kept, chunk_rows=chunk_rows)
        .where(
            (F.col("rows_before") < end) & (F.col("rows_before") + F.col("chunk_count") > start)
        )
        .select(*DATASET_KEYS, "chunk", "rows_before")
    )
    inside = Window.partitionBy(*DATASET_KEYS, "chunk").orderBy("ordinal")
    return (
        with_chunk(kept, chunk_rows)
        .join(touched, [*DATASET_KEYS, "chunk"])
        .withColumn("place", F.row_number().over(inside))
        .where((F.col("place") <= end))
        .withColumn("position", F.col("rows_before") + F.col("place") - 1)
        .where((F.col("position") >= start) & (F.col("position") < end))
        .drop("place", "rows_before", "chunk")
    )


def dense_page(rows: DataFrame, page: int, page_size: int) -> DataFrame:
    """Unfiltered page of rows whose ordinals run 0, 1, 2, ...: a pushed-down range."""
    start = page * page_size
    return rows.where((F.col("ordinal") >= start) & (F.col("ordinal") < start + page_size))


def scalar_channel_ids(channels: DataFrame) -> DataFrame:
    """Readable scalar channels: stored as table columns, no sample shape, numeric."""
    return channels.where(
        (F.col("storage_kind") == "parquet")
        & (F.size("sample_shape") == 0)
        & (F.col("data_type") == "numeric")
    )


def select_channels(
    channels: DataFrame, curve_ids: Sequence[str] | None = None, default_limit: int | None = None
) -> DataFrame:
    """Readable channels of each dataset in request order (``request_position``).

    Without ids the catalog order counts, cut to ``default_limit`` where given.
    """
    available = scalar_channel_ids(channels)
    if curve_ids is None:
        if default_limit is None:
            return available.withColumn("request_position", F.col("position"))
        order = Window.partitionBy(*DATASET_KEYS).orderBy("position")
        placed = available.withColumn("request_position", F.row_number().over(order) - 1)
        return placed.where(F.col("request_position") < default_limit)
    wanted = F.array(*[F.lit(curve) for curve in curve_ids])
    return available.where(F.col("channel_id").isin(*curve_ids)).withColumn(
        "request_position", F.array_position(wanted, F.col("channel_id")) - 1
    )


def missing_channels(channels: DataFrame, curve_ids: Sequence[str]) -> DataFrame:
    """Requested ids a dataset does not offer, one row each."""
    available = scalar_channel_ids(channels)
    wanted = available.select(*DATASET_KEYS).distinct().withColumn(
        "channel_id", F.explode(F.array(*[F.lit(curve) for curve in curve_ids]))
    )
    return wanted.join(available, [*DATASET_KEYS, "channel_id"], "left_anti").withColumn(
        "message", F.concat(F.lit("Scalar curves were not found: "), F.col("channel_id"))
    )


def page_curve_ids(channels: DataFrame, document_id: str, dataset_id: str,
                   curve_ids: Sequence[str] | None = None,
                   default_limit: int | None = DEFAULT_PAGE_CURVES) -> list[str]:
    """Ids for one dataset's page or export; raises when an id is unknown."""
    one = channels.where(
        (F.col("document_id") == document_id) & (F.col("dataset_id") == dataset_id)
    )
    if curve_ids is not None:
        offered = {
            row.channel_id
            for row in select_channels(one, curve_ids).select("channel_id").collect()
        }
        missing = [curve for curve in curve_ids if curve not in offered]
        if missing:
            raise ValueError(f"Scalar curves were not found: {', '.join(missing)}")
        return list(curve_ids)
    chosen = select_channels(one, None, default_limit).orderBy("request_position")
    ids = [row.channel_id for row in chosen.select("channel_id").collect()]
    if not ids:
        raise ValueError("The dataset does not contain selected scalar curves.")
    return ids


def sample_page(
    samples: DataFrame,
    axis: DataFrame,
    curve_ids: Sequence[str],
    page: int,
    page_size: int,
    index_minimum: float | None = None,
    index_maximum: float | None = None,
) -> DataFrame:
    """Page with columns ``__index`` and one per curve id, in request order."""
    keys = [*DATASET_KEYS, "ordinal"]
    if index_minimum is None and index_maximum is None:
        rows = dense_page(axis, page, page_size)
        cells = dense_page(samples, page, page_size)
    else:
        rows = page_rows(axis, page, page_size, index_minimum, index_maximum)
        cells = samples.where(optional_range(index_minimum, index_maximum)).join(
            rows.select(*keys), keys, "left_semi"
        )
    wide = pivot_channels(cells, curve_ids).drop("index")
    return (
        rows.select(*keys, F.col("index").alias("__index"))
        .join(wide, keys, "left")
        .orderBy(*keys)
        .drop("ordinal")
    )


def unique_headers(headers: DataFrame) -> DataFrame:
    """Second and later uses of a header get ``_2``, ``_3``, ... by position."""
    use = F.row_number().over(
        Window.partitionBy(*DATASET_KEYS, "header").orderBy("position")
    )
    return headers.withColumn(
        "unique_header",
        F.when(use == 1, F.col("header")).otherwise(
            F.concat_ws("_", "header", use.cast("string"))
        ),
    )


def header_names(names: Sequence[str]) -> list[str]:
    """``unique_headers`` for the handful of names of one export."""
    return [
        name if names[:place].count(name) == 0 else f"{name}_{names[:place].count(name) + 1}"
        for place, name in enumerate(names)
    ]


def export_csv(
    axis: DataFrame,
    samples: DataFrame,
    channels: DataFrame,
    document_id: str,
    dataset_id: str,
    index_mnemonic: str,
    destination: str,
    curve_ids: Sequence[str] | None = None,
) -> list[str]:
    """Write one dataset completely as CSV text in ordinal order.

    The header is the first line of the first part file and part files are
    range-partitioned by ordinal: put together in name order they are the CSV
    document. Returns the header.
    """
    ids = page_curve_ids(channels, document_id, dataset_id, curve_ids, default_limit=None)
    here = (F.col("document_id") == document_id) & (F.col("dataset_id") == dataset_id)
    named = {
        row.channel_id: row.mnemonic
        for row in channels.where(here & F.col("channel_id").isin(*ids))
        .select("channel_id", "mnemonic")
        .collect()
    }
    header = header_names([index_mnemonic, *[named[curve] for curve in ids]])
    keys = [*DATASET_KEYS, "ordinal"]
    wide = (
        axis.where(here)
        .select(*keys, "index")
        .join(pivot_channels(samples.where(here), ids).drop("index"), keys, "left")
        .select("ordinal", F.to_csv(F.struct("index", *[F.col(f"`{curve}`") for curve in ids])).alias("line"))
    )
    first = axis.sparkSession.createDataFrame(
        [(-1, ",".join(_quoted(name) for name in header))], "ordinal bigint, line string"
    )
    (
        first.unionByName(wide)
        .orderBy("ordinal")
        .select("line")
        .write.mode("overwrite")
        .option("lineSep", "\r\n")
        .text(destination)
    )
    return header


def _quoted(name: str) -> str:
    if any(mark in name for mark in ',"\r\n'):
        return '"' + name.replace('"', '""') + '"'
    return name
