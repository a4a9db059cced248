"""Decoded frame tables and array collections to the canonical tables.

A frame table has the dataset keys, a dense ``ordinal`` and one column per
channel, scalar or array. The first channel is the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveframe.functions.numeric import nan_to_null, try_cast
from curveframe.functions.text import channel_id, column_slug, first_text, non_empty
from curveframe.functions.timeindex import frame_index_kind
from curveframe.operators.catalog import frame_edges
from curveframe.operators.index_selection import unique_column_names
from curveframe.operators.stats import (
    array_statistics,
    curve_statistics,
    index_extent,
    preview_samples,
    sample_shapes,
)
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS, DEFAULT_PREVIEW_POINTS
from curveframe.sources.witsml import CurveTables

FIGURES = ["minimum", "maximum", "sample_count", "null_count"]


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def with_index(frame: DataFrame, index_field: str) -> DataFrame:
    """``frame`` with its index field as ``index``; a text index that is no number gives row ordinals.

    Rows keep their cells: a numeric index is a projection, and a text index only
    joins one flag per dataset.
    """
    kind = frame.schema[index_field].dataType
    raw = F.col(index_field)
    if is_numeric_type(kind):
        return frame.withColumn("index", nan_to_null(raw.cast("double"))).drop(index_field)
    number = try_cast(raw, "double")
    numeric = frame.groupBy(*DATASET_KEYS).agg(
        (F.count_if(raw.isNotNull() & number.isNull()) == 0).alias("is_numeric")
    )
    index = nan_to_null(F.when(F.col("is_numeric"), number).otherwise(F.col("ordinal").cast("double")))
    return frame.join(numeric, DATASET_KEYS).withColumn("index", index).drop("is_numeric", index_field)


def frame_axis(frame: DataFrame, index_field: str) -> DataFrame:
    """Index axis of a frame."""
    return with_index(frame, index_field).select(*DATASET_KEYS, "ordinal", "index")


def flattened(field: str, kind: T.DataType) -> tuple[Column, Column]:
    """(values in reading order, shape) of a possibly nested array column."""
    values, sizes = F.col(field), [F.size(field)]
    inner = kind.elementType
    while isinstance(inner, T.ArrayType):
        sizes.append(F.size(F.get(values, F.lit(0))))
        values = F.flatten(values)
        inner = inner.elementType
    return F.transform(values, lambda item: item.cast("double")), F.array(*sizes)


def ingest_frames(
    frame: DataFrame,
    fields: Sequence[str],
    metadata: DataFrame,
    preview_points: int = DEFAULT_PREVIEW_POINTS,
) -> tuple[CurveTables, DataFrame]:
    """Canonical tables of frames that share the given fields, and their ``contains`` edges.

    ``metadata`` has one row per dataset and field: ``field``, ``name``,
    ``units``, ``long_name``, ``fingerprint``, ``frame_object_id``,
    ``frame_name``, ``index_type`` and ``well_name``.
    """
    index_field, others = fields[0], list(fields[1:])
    kinds = {name: frame.schema[name].dataType for name in others}
    arrays = [name for name in others if isinstance(kinds[name], T.ArrayType)]
    numbers = [name for name in others if is_numeric_type(kinds[name])]
    texts = [name for name in others if name not in arrays and name not in numbers]
    positions = F.create_map(
        *[item for place, name in enumerate(others) for item in (F.lit(name), F.lit(place))]
    )

    keyed = with_index(frame, index_field)
    axis = keyed.select(*DATASET_KEYS, "ordinal", "index")
    described = (
        metadata.where(F.col("field").isin(*others))
        .withColumn("position", positions[F.col("field")])
        .withColumn("mnemonic", first_text("name", F.col("field")))
        .withColumn(
            "channel_id", channel_id(F.col("position") + 1, "mnemonic", F.col("dataset_id"))
        )
    )
    ids = described.select(*DATASET_KEYS, "field", "channel_id")

    carried = [*DATASET_KEYS, "ordinal", "index"]
    typed = keyed.select(
        *carried,
        *[
            F.struct(
                nan_to_null(F.col(name).cast("double")).alias("value"),
                F.lit(None).cast("string").alias("text_value"),
            ).alias(name)
            for name in numbers
        ],
        *[
            F.struct(
                F.lit(None).cast("double").alias("value"),
                F.col(name).cast("string").alias("text_value"),
            ).alias(name)
            for name in texts
        ],
    )
    scalar_names = numbers + texts
    if scalar_names:
        long = typed.unpivot(carried, scalar_names, "field", "cell").select(
            *carried, "field", "cell.*"
        )
    else:
        long = keyed.where(F.lit(False)).select(
            *carried,
            F.lit("").alias("field"),
            F.lit(None).cast("double").alias("value"),
            F.lit(None).cast("string").alias("text_value"),
        )
    samples = long.join(ids, [*DATASET_KEYS, "field"]).select(
        *CHANNEL_KEYS, "ordinal", "index", "value", "text_value"
    )

    parts = []
    for name in arrays:
        values, shape = flattened(name, kinds[name])
        parts.append(
            keyed.select(*carried, F.lit(name).alias("field"), shape.alias("shape"), values.alias("values"))
        )
    if parts:
        listed = parts[0]
        for part in parts[1:]:
            listed = listed.unionByName(part)
    else:
        listed = keyed.where(F.lit(False)).select(
            *carried,
            F.lit("").alias("field"),
            F.array().cast("array<int>").alias("shape"),
            F.array().cast("array<double>").alias("values"),
        )
    array_samples = listed.join(ids, [*DATASET_KEYS, "field"]).select(
        *CHANNEL_KEYS, "ordinal", "index", "shape", "values"
    )

    channels = _channels(described, samples, array_samples, texts)
    first = metadata.where(F.col("field") == index_field)
    index_name = first_text("name", F.col("field"))
    kind = frame_index_kind("index_type", index_name)
    datasets = first.join(index_extent(axis), DATASET_KEYS).select(
        *DATASET_KEYS,
        F.lit(0).alias("position"),
        first_text("frame_name", F.col("dataset_id")).alias("name"),
        F.lit("log").alias("kind"),
        "well_name",
        F.lit("Imported wellbore").alias("wellbore_name"),
        "row_count",
        index_name.alias("index_mnemonic"),
        F.coalesce(non_empty("units"), F.lit("")).alias("index_unit"),
        kind.alias("index_kind"),
        "index_minimum",
        "index_maximum",
        F.to_json(
            F.struct(
                F.when(kind == "time", "elapsed").otherwise("none").alias("time_index_reference")
            )
        ).alias("native_metadata"),
    )
    previews = preview_samples(axis, samples, preview_points)
    edges = frame_edges(
        described.select(
            "document_id",
            "frame_object_id",
            "mnemonic",
            F.to_json(F.struct("fingerprint")).alias("native_metadata"),
        )
    )
    return CurveTables(datasets, channels, axis, samples, array_samples, previews), edges


def _channels(
    described: DataFrame, samples: DataFrame, array_samples: DataFrame, texts: Sequence[str]
) -> DataFrame:
    named = unique_column_names(described.withColumn("place", F.col("position") + 1), position="place").drop("place")
    scalar = curve_statistics(samples).select(
        *CHANNEL_KEYS,
        *FIGURES,
        F.array().cast("array<int>").alias("sample_shape"),
        F.lit("parquet").alias("storage_kind"),
        F.concat(F.lit("data/scalar/"), "dataset_id", F.lit(".parquet")).alias("asset_path"),
    )
    arrays = (
        array_statistics(array_samples)
        .join(sample_shapes(array_samples), CHANNEL_KEYS)
        .select(
            *CHANNEL_KEYS,
            *FIGURES,
            "sample_shape",
            F.lit("zarr").alias("storage_kind"),
            F.concat_ws("/", F.lit("data/arrays"), "dataset_id", "channel_id").alias("asset_path"),
        )
    )
    is_text = F.col("field").isin(*texts) if texts else F.lit(False)
    return named.join(scalar.unionByName(arrays), CHANNEL_KEYS).select(
        *CHANNEL_KEYS,
        F.col("position").cast("int").alias("position"),
        "mnemonic",
        F.coalesce(non_empty("units"), F.lit("")).alias("unit"),
        first_text("long_name", F.lit("Imported DLIS channel")).alias("description"),
        "minimum",
        "maximum",
        "sample_count",
        # Text has no numeric statistics, so no nulls are counted for it.
        F.when(is_text, F.lit(0)).otherwise(F.col("null_count")).alias("null_count"),
        "sample_shape",
        "storage_kind",
        F.when(is_text, "text").otherwise("numeric").alias("data_type"),
        "asset_path",
        F.to_json(
            F.struct(F.col("column_name").alias("parquet_column"), "fingerprint")
        ).alias("native_metadata"),
    )


def ingest_array_collection(
    arrays: DataFrame, well_name: str, companion: str = ""
) -> CurveTables:
    """Companion arrays as a dataset indexed by sample number.

    ``arrays`` has (dataset, position, name, unit, ordinal, shape, values), one row
    per first-axis entry. Null counts here are of elements, not of rows.
    """
    named = arrays.withColumn(
        "channel_id",
        F.concat_ws(
            "-",
            F.lit("array"),
            "dataset_id",
            (F.col("position") + 1).cast("string"),
            F.regexp_replace(column_slug("name"), "_", "-"),
        ),
    )
    array_samples = named.select(
        *CHANNEL_KEYS,
        "ordinal",
        F.col("ordinal").cast("double").alias("index"),
        "shape",
        "values",
    )
    facts = named.select(*CHANNEL_KEYS, "position", "name", "unit").distinct()
    figures = array_statistics(array_samples).join(sample_shapes(array_samples), CHANNEL_KEYS)
    channels = facts.join(figures, CHANNEL_KEYS).select(
        *CHANNEL_KEYS,
        F.col("position").cast("int").alias("position"),
        F.col("name").alias("mnemonic"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.lit("Imported WITSML companion array").alias("description"),
        "minimum",
        "maximum",
        "sample_count",
        F.col("null_element_count").alias("null_count"),
        "sample_shape",
        F.lit("zarr").alias("storage_kind"),
        F.lit("numeric").alias("data_type"),
        F.concat_ws("/", F.lit("data/arrays"), "dataset_id", "channel_id").alias("asset_path"),
        F.to_json(F.struct(F.col("name").alias("array_path"))).alias("native_metadata"),
    )
    datasets = (
        channels.groupBy(*DATASET_KEYS)
        .agg(F.max("sample_count").alias("row_count"))
        .select(
            *DATASET_KEYS,
            F.lit(0).alias("position"),
            F.lit(companion).alias("name"),
            F.lit("array_collection").alias("kind"),
            F.lit(well_name).alias("well_name"),
            F.lit("Imported wellbore").alias("wellbore_name"),
            "row_count",
            F.lit("SAMPLE").alias("index_mnemonic"),
            F.lit("").alias("index_unit"),
            F.lit("sample").alias("index_kind"),
            F.lit(0.0).alias("index_minimum"),
            (F.col("row_count") - 1).cast("double").alias("index_maximum"),
            F.to_json(F.struct(F.lit(companion).alias("companion_file"))).alias("native_metadata"),
        )
    )
    axis = array_samples.select(*DATASET_KEYS, "ordinal", "index").distinct()
    samples = array_samples.where(F.lit(False)).select(
        *CHANNEL_KEYS,
        "ordinal",
        "index",
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("text_value"),
    )
    return CurveTables(
        datasets, channels, axis, samples, array_samples, preview_samples(axis, samples, DEFAULT_PREVIEW_POINTS)
    )
