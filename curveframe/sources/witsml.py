"""XML curve objects: logs of both generations, trajectories and plain objects.

Raw documents are parsed with ``from_xml`` against one schema that covers both
generations; element names match whatever their letter case or namespace prefix.
Index values, channel ids and cells stand in arrays of one row per log, so bulk
values are exploded next to their index and nothing is joined by row number. Object
headers, whose content is open-ended, are read from the XML tags of the document
with the bulk data removed; depths and object borders are folded inside its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.arrays import let, running_sums
from curveframe.functions.numeric import finite_number, is_finite, nan_to_null, try_cast
from curveframe.functions.text import channel_id, file_stem, first_text, non_empty, slug, strip
from curveframe.functions.timeindex import canonical_index, iso_epoch, log_index_kind
from curveframe.operators.index_selection import unique_column_names
from curveframe.operators.stats import (
    array_statistics,
    curve_statistics,
    index_extent,
    preview_samples,
    sample_shapes,
)
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS, DEFAULT_PREVIEW_POINTS
from curveframe.session import cut_lineage

CHANNEL_SET = (
    "struct<Citation:struct<Title:string>, Title:string, Name:string, "
    "Index:array<struct<Mnemonic:string,IndexType:string,TimeDepth:string,Uom:string>>, "
    "ChannelIndex:array<struct<Mnemonic:string,IndexType:string,TimeDepth:string,Uom:string>>, "
    "Channel:array<struct<Mnemonic:string,Uom:string>>, "
    "Data:struct<_VALUE:string,Data:string,ChannelData:string>, ChannelData:string>"
)
LOG_FIELDS = (
    "_uuid:string, _uid:string, _uidWell:string, _uidWellbore:string, "
    "Citation:struct<Title:string>, name:string, nameWell:string, nameWellbore:string, "
    "WellName:string, indexType:string, "
    "logCurveInfo:array<struct<mnemonic:string,unit:string,curveDescription:string,nullValue:string>>, "
    "logData:array<struct<mnemonicList:string,unitList:string,data:array<string>>>, "
    f"ChannelSet:array<{CHANNEL_SET}>"
)
MEASURE = "struct<_uom:string,_VALUE:string>"
# Trajectory channels and the element names they are read from.
STATION_FIELDS = {
    "MD": ("md", "MeasuredDepth"),
    "INCL": ("incl", "Inclination"),
    "AZI": ("azi", "Azimuth"),
    "TVD": ("tvd", "TrueVerticalDepth"),
    "NS": ("dispNs", "NorthSouth"),
    "EW": ("dispEw", "EastWest"),
}
STATION = "struct<{}>".format(
    ",".join(f"{name}:{MEASURE}" for names in STATION_FIELDS.values() for name in names)
)
STATION_LISTS = f"trajectoryStation:array<{STATION}>, Station:array<{STATION}>"


DOCUMENT = (
    f"struct<{LOG_FIELDS}, {STATION_LISTS}, log:array<struct<{LOG_FIELDS}>>, "
    f"trajectory:array<struct<{LOG_FIELDS}, {STATION_LISTS}>>, _corrupt_record:string>"
)
# What follows the name in a tag: an attribute value may hold any sign, ``>`` included.
IN_TAG = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
XML_OPTIONS = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}


@dataclass(frozen=True)
class CurveTables:
    """Canonical tables of a set of curve documents."""

    datasets: DataFrame
    channels: DataFrame
    axis: DataFrame
    samples: DataFrame
    array_samples: DataFrame
    preview_samples: DataFrame


def read_documents(
    raw: DataFrame, stage: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Root name, namespace, version, file warning and parsed content per document.

    ``stage`` keeps the parsed documents: every table below reads them.
    """
    body = F.regexp_replace("content", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", "")
    root = rf"^<(?:([\w.-]+):)?([\w.-]+)({IN_TAG})>"
    attributes = F.col("root_attributes")
    prefix = F.regexp_extract("head", root, 1)
    bindings = F.arrays_zip(
        F.regexp_extract_all(attributes, F.lit(r"""xmlns:([\w.-]+)\s*="""), 1).alias("name"),
        F.regexp_extract_all(
            attributes, F.lit(r"""xmlns:[\w.-]+\s*=\s*["']([^"']*)["']"""), 1
        ).alias("uri"),
    )
    declared = F.when(
        prefix == "", F.regexp_extract(attributes, r"""\bxmlns\s*=\s*["']([^"']*)["']""", 1)
    ).otherwise(
        F.get(F.filter(bindings, lambda item: item["name"] == prefix), F.lit(0))["uri"]
    )
    explicit = F.coalesce(
        F.nullif(F.regexp_extract(attributes, r"""(?:^|\s)version\s*=\s*["']([^"']*)["']""", 1), F.lit("")),
        F.nullif(
            F.regexp_extract(attributes, r"""(?:^|\s)schemaVersion\s*=\s*["']([^"']*)["']""", 1), F.lit("")
        ),
    )
    parsed = F.from_xml("content", DOCUMENT, XML_OPTIONS)
    headed = (
        raw.withColumn("head", body)
        .withColumn("root_name", F.regexp_extract("head", root, 2))
        .withColumn("root_attributes", F.regexp_extract("head", root, 3))
        .withColumn("namespace", F.coalesce(declared, F.lit("")))
        .withColumn(
            "version",
            F.coalesce(
                explicit,
                F.when(F.contains(F.lower("namespace"), F.lit("witsmlv2")), "2.x").otherwise("1.4.1.1"),
            ),
        )
        .withColumn("doc", parsed)
    )
    broken = (F.col("root_name") == "") | F.col("doc._corrupt_record").isNotNull() | F.col("doc").isNull()
    foreign = ~F.contains(F.lower("namespace"), F.lit("witsml"))
    checked = headed.withColumn(
        "problem",
        F.when(broken, F.concat(F.lit("Could not parse "), "file_name")).when(
            foreign, F.concat("file_name", F.lit(" is not a recognized WITSML XML document."))
        ),
    ).drop("head", "root_attributes")
    return stage(checked)


def document_warnings(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("problem").isNotNull()).select(
        "document_id", F.lit(0).alias("ordinal"), F.col("problem").alias("message")
    )


def _objects_of(documents: DataFrame, tag: str, listed: str, fields: list[str]) -> DataFrame:
    """One row per object of a kind: a plural root's children, or the root itself."""
    alone = F.array(F.struct(*[F.col(f"doc.{field}").alias(field) for field in fields]))
    children = F.transform(
        f"doc.{listed}", lambda item: F.struct(*[item[field].alias(field) for field in fields])
    )
    items = F.when(F.lower("root_name") == tag, alone).otherwise(children)
    return documents.where(F.col("problem").isNull()).select(
        "document_id", "file_name", "root_name", F.posexplode(items).alias("object_index", "item")
    )


LOG_FIELD_NAMES = [
    "_uuid", "_uid", "_uidWell", "_uidWellbore", "Citation", "name", "nameWell", "nameWellbore",
    "WellName", "indexType", "logCurveInfo", "logData", "ChannelSet",
]


def _native_id() -> Column:
    return first_text(
        "item._uuid", "item._uid", "item._uidWell", "item._uidWellbore", F.lit("")
    )


def _dataset_id(stem: str, *parts: Column) -> Column:
    return F.concat_ws(
        "-", F.lit(stem), *[part.cast("string") for part in parts], F.left("document_id", F.lit(10))
    )


def _column_logs(documents: DataFrame) -> DataFrame:
    """First-generation logs: one row per log with its split mnemonics and raw lines."""
    logs = _objects_of(documents, "log", "log", LOG_FIELD_NAMES)
    names = F.split(F.get("item.logData.mnemonicList", F.lit(0)), ",")
    units = F.split(F.get("item.logData.unitList", F.lit(0)), ",")
    lines = F.flatten(
        F.transform("item.logData", lambda part: F.coalesce(part["data"], F.array().cast("array<string>")))
    )
    split = logs.select(
        "document_id",
        "root_name",
        "object_index",
        _dataset_id("dataset-witsml-log", F.col("object_index") + 1).alias("dataset_id"),
        F.col("object_index").cast("int").alias("position"),
        "item",
        F.transform(names, strip).alias("mnemonics"),
        F.transform(units, strip).alias("units"),
        lines.alias("lines"),
    )

    def last_info(mnemonic: Column) -> Column:
        same = F.filter("item.logCurveInfo", lambda info: strip(info["mnemonic"]) == mnemonic)
        return F.try_element_at(same, F.lit(-1))

    described = split.withColumn("infos", F.transform("mnemonics", last_info)).withColumn(
        "sentinels", F.transform("infos", lambda info: non_empty(info["nullValue"]))
    )
    first_cell = F.transform(
        "lines", lambda line: non_empty(F.substring_index(line, ",", 1))
    )
    mark = F.get("sentinels", F.lit(0))
    indexed = described.withColumn("index_cells", first_cell).withColumn(
        "index_texts", F.transform("index_cells", lambda raw: _without(raw, mark))
    )
    ids = F.transform("mnemonics", lambda mnemonic, at: channel_id(at, mnemonic, F.col("dataset_id")))
    return _with_index(indexed.drop("index_cells").withColumn("channel_ids", ids))


def _column_samples(logs: DataFrame) -> DataFrame:
    """One row per cell next to its index, short lines padded with nulls, null sentinels removed."""
    lines = logs.select(
        *DATASET_KEYS, "sentinels", "channel_ids", "index_values", F.posexplode("lines").alias("ordinal", "line")
    )
    cells = lines.select(
        *DATASET_KEYS,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.get("index_values", F.col("ordinal")).alias("index"),
        F.split("line", ",").alias("parts"),
        "channel_ids",
        F.posexplode("sentinels").alias("position", "sentinel"),
    ).where(F.col("position") > 0)
    raw = non_empty(F.get("parts", F.col("position")))
    held = cells.select(
        *DATASET_KEYS,
        F.get("channel_ids", F.col("position")).alias("channel_id"),
        "ordinal",
        "index",
        "sentinel",
        raw.alias("raw"),
    )
    return _scalar_samples(held.withColumn("raw", _without(F.col("raw"), F.col("sentinel"))))


def _without(raw: Column, sentinel: Column) -> Column:
    """Parsed equality with the null sentinel: numbers as numbers, the rest as text."""
    same = F.coalesce(
        try_cast(raw, "double") == try_cast(sentinel, "double"), raw == sentinel, F.lit(False)
    )
    return F.when(~same, raw)


def _with_index(logs: DataFrame) -> DataFrame:
    """Adds the index of each row: numbers if any text is one, else ISO dates, else row numbers."""
    numeric = F.exists("index_texts", lambda raw: is_finite(try_cast(raw, "double")))
    dated = F.exists("index_texts", lambda raw: iso_epoch(raw).isNotNull())
    index = let(
        numeric,
        lambda any_numeric: let(
            ~any_numeric & dated,
            lambda any_dated: F.transform("index_texts", lambda raw, at: canonical_index(raw, any_numeric, any_dated, at)),
        ),
    )
    return logs.withColumn("index_values", index)


def _set_logs(documents: DataFrame) -> DataFrame:
    """Second-generation channel sets: one row per set with its valid data rows."""
    logs = _objects_of(documents, "log", "log", LOG_FIELD_NAMES)
    sets = logs.select(
        "document_id",
        "root_name",
        "object_index",
        "item",
        F.posexplode("item.ChannelSet").alias("set_index", "channel_set"),
    ).where(F.get("item.logData.mnemonicList", F.lit(0)).isNull())
    payload = F.coalesce(
        *[
            non_empty(f"channel_set.{name}")
            for name in ("Data.Data", "Data.ChannelData", "Data._VALUE", "ChannelData")
        ]
    )
    rows = F.from_json(payload, "array<string>")
    return (
        sets.withColumn("all_rows", rows)
        .where(F.size("all_rows") > 0)
        .withColumn("first_row", F.from_json(F.get("all_rows", F.lit(0)), "array<string>"))
        .withColumn("bad_shape", F.coalesce(F.size("first_row") != 2, F.lit(True)))
        .withColumn("rows", F.filter(F.transform("all_rows", _row_pair), _is_valid_pair))
        .select(
            "document_id",
            _dataset_id(
                "dataset-witsml2-log", F.col("object_index") + 1, F.col("set_index") + 1
            ).alias("dataset_id"),
            (
                F.row_number().over(Window.partitionBy("document_id").orderBy("object_index", "set_index")) - 1
            ).alias("position"),
            "root_name",
            "object_index",
            "set_index",
            "item",
            "channel_set",
            "bad_shape",
            "rows",
            F.transform("rows", lambda row: F.get(row["index"], F.lit(0))).alias("index_texts"),
        )
    )


def _row_pair(row: Column) -> Column:
    """(index values, cells) of one ``[[index, ...], [cell, ...]]`` row."""
    halves = F.from_json(row, "array<string>")
    return F.struct(
        F.size(halves).alias("halves"),
        F.from_json(F.get(halves, F.lit(0)), "array<string>").alias("index"),
        F.from_json(F.get(halves, F.lit(1)), "array<string>").alias("cells"),
    )


def _is_valid_pair(pair: Column) -> Column:
    return (
        (pair["halves"] == 2)
        & F.coalesce(F.size(pair["index"]) > 0, F.lit(False))
        & pair["cells"].isNotNull()
    )


# Warnings.
NO_MNEMONICS = "The WITSML log does not define a mnemonic list."
NO_ROWS = "The WITSML log does not contain data rows."
BAD_SHAPE = "WITSML 2.x ChannelData rows have an unsupported shape."


def _readable_log() -> Column:
    return (F.size("mnemonics") > 0) & (F.get("mnemonics", F.lit(0)) != "") & (F.size("lines") > 0)


def _could_not(reason: Column) -> Column:
    kind = F.when(F.lower("root_name") == "log", F.col("root_name")).otherwise("log")
    name = first_text("item.name", "item.Citation.Title", _native_id())
    return F.concat(F.lit("WITSML "), kind, F.lit(" "), name, F.lit(" could not be normalized: "), reason)


def log_warnings(documents: DataFrame) -> DataFrame:
    """One row per log that gives no dataset because its lists, rows or row shape are missing or wrong."""
    columns = _column_logs(documents).where((F.size("item.logData") > 0) & F.col("item.ChannelSet").isNull())
    named = (F.size("mnemonics") > 0) & (F.get("mnemonics", F.lit(0)) != "")
    unread = columns.where(~F.coalesce(_readable_log(), F.lit(False))).select(
        "document_id", "object_index", _could_not(F.when(named, NO_ROWS).otherwise(NO_MNEMONICS)).alias("message")
    )
    sets = _set_logs(documents).where("bad_shape").select(
        "document_id", "object_index", _could_not(F.lit(BAD_SHAPE)).alias("message")
    )
    order = Window.partitionBy("document_id").orderBy("object_index", "message")
    return unread.unionByName(sets.distinct()).select(
        "document_id", (F.row_number().over(order) - 1).alias("ordinal"), "message"
    )


def _axis(logs: DataFrame) -> DataFrame:
    """Index axis: the index of each row and its text."""
    rows = logs.select(
        *DATASET_KEYS, F.posexplode(F.arrays_zip("index_values", "index_texts")).alias("ordinal", "row")
    )
    return rows.select(
        *DATASET_KEYS,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("row.index_values").alias("index"),
        F.create_map(F.lit("value"), F.col("row.index_texts")).alias("index_source"),
    )


def _scalar_samples(cells: DataFrame) -> DataFrame:
    number = try_cast(F.col("raw"), "double")
    return cells.select(
        *CHANNEL_KEYS,
        "ordinal",
        "index",
        nan_to_null(number).alias("value"),
        F.when(number.isNull(), F.col("raw")).alias("text_value"),
    )


def _finish(
    datasets: DataFrame,
    described: DataFrame,
    axis: DataFrame,
    samples: DataFrame,
    array_samples: DataFrame,
    preview_points: int,
) -> CurveTables:
    """Add measured figures, types and previews to described datasets and channels."""
    figures = ["minimum", "maximum", "sample_count", "null_count"]
    text_cells = samples.groupBy(*CHANNEL_KEYS).agg(
        F.count("text_value").alias("text_count")
    )
    scalar = (
        curve_statistics(samples)
        .join(text_cells, CHANNEL_KEYS)
        .select(
            *CHANNEL_KEYS,
            *figures,
            F.array().cast("array<int>").alias("sample_shape"),
            F.lit("parquet").alias("storage_kind"),
            F.when(F.col("text_count") > 0, "text").otherwise("numeric").alias("data_type"),
            F.concat(F.lit("data/scalar/"), "dataset_id", F.lit(".parquet")).alias("asset_path"),
        )
    )
    arrays = (
        array_statistics(array_samples)
        .join(sample_shapes(array_samples), CHANNEL_KEYS)
        .select(
            *CHANNEL_KEYS,
            *figures,
            "sample_shape",
            F.lit("zarr").alias("storage_kind"),
            F.lit("numeric").alias("data_type"),
            F.concat_ws("/", F.lit("data/arrays"), "dataset_id", "channel_id").alias("asset_path"),
        )
    )
    named = unique_column_names(described)
    channels = named.join(scalar.unionByName(arrays), CHANNEL_KEYS).select(
        *CHANNEL_KEYS,
        F.col("position").cast("int").alias("position"),
        "mnemonic",
        "unit",
        "description",
        *figures,
        "sample_shape",
        "storage_kind",
        "data_type",
        "asset_path",
        F.to_json(F.struct(F.col("column_name").alias("parquet_column"))).alias("native_metadata"),
    )
    extent = index_extent(axis).select(*DATASET_KEYS, "row_count", "index_minimum", "index_maximum")
    previews = preview_samples(axis, samples, preview_points)
    full = datasets.join(extent, DATASET_KEYS).select(
        *DATASET_KEYS, "position", "name", "kind", "well_name", "wellbore_name", "row_count",
        "index_mnemonic", "index_unit", "index_kind", "index_minimum", "index_maximum",
        "native_metadata",
    )
    return CurveTables(full, channels, axis, samples, array_samples, previews)


def _reference_json(id_field: str, kind: Column) -> Column:
    return F.to_json(
        F.struct(
            _native_id().alias(id_field),
            F.when(kind == "time", "absolute_utc").otherwise("none").alias("time_index_reference"),
        )
    )


def ingest_column_logs(
    documents: DataFrame, preview_points: int = DEFAULT_PREVIEW_POINTS
) -> CurveTables:
    """First-generation logs: mnemonic and unit lists, comma rows, curve info."""
    logs = cut_lineage(_column_logs(documents)).where(_readable_log())
    axis = _axis(logs)
    described = (
        logs.select(
            *DATASET_KEYS,
            "units",
            F.posexplode(F.arrays_zip("mnemonics", "infos", "channel_ids")).alias("list_position", "entry"),
        )
        .where(F.col("list_position") > 0)
        .select(
            *DATASET_KEYS,
            F.col("entry.channel_ids").alias("channel_id"),
            (F.col("list_position") - 1).alias("position"),
            F.col("entry.mnemonics").alias("mnemonic"),
            F.coalesce(
                non_empty("entry.infos.unit"),
                non_empty(F.get("units", F.col("list_position"))),
                F.lit(""),
            ).alias("unit"),
            first_text("entry.infos.curveDescription", F.lit("Imported WITSML curve")).alias(
                "description"
            ),
        )
    )
    samples = _column_samples(logs)
    kind = log_index_kind("item.indexType")
    datasets = logs.select(
        *DATASET_KEYS,
        "position",
        first_text("item.name", F.lit("WITSML log")).alias("name"),
        F.lit("log").alias("kind"),
        first_text("item.nameWell", F.lit("Unknown well")).alias("well_name"),
        first_text("item.nameWellbore", F.lit("Imported wellbore")).alias("wellbore_name"),
        F.get("mnemonics", F.lit(0)).alias("index_mnemonic"),
        F.coalesce(F.get("units", F.lit(0)), F.lit("")).alias("index_unit"),
        kind.alias("index_kind"),
        _reference_json("uid", kind).alias("native_metadata"),
    )
    return _finish(datasets, described, axis, samples, _no_arrays(samples), preview_points)


def _no_arrays(samples: DataFrame) -> DataFrame:
    return samples.where(F.lit(False)).select(
        *CHANNEL_KEYS,
        "ordinal",
        "index",
        F.array().cast("array<int>").alias("shape"),
        F.array().cast("array<double>").alias("values"),
    )


def nested_shape(raw: Column) -> Column:
    """Dimensions of a JSON list of any depth, those of the first list at each level.

    The first list of a level ends at the first run of as many closing brackets as
    there are levels from it down; one bracket less and a comma part its elements.
    """
    tight = F.regexp_replace(raw, r"\s", "")
    depth = F.length(F.regexp_extract(tight, r"^\[*", 0))

    def dimension(level: Column) -> Column:
        rest = F.substring(tight, level + 2, F.length(tight))
        inner = F.substring(rest, F.lit(1), F.instr(rest, F.repeat(F.lit("]"), depth - level)) - 1)
        part = F.concat(F.repeat(F.lit("]"), depth - level - 1), F.lit(","))
        parts = (F.length(inner) - F.length(F.replace(inner, part, F.lit("")))) / F.length(part)
        return F.when(inner == "", 0).otherwise(parts + 1).cast("int")

    levels = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.from_json(raw, "array<string>").isNotNull(), F.transform(levels, dimension)).otherwise(
        F.array().cast("array<int>")
    )


def nested_values(raw: Column) -> Column:
    """Numbers of a JSON list in reading order, whatever its nesting."""
    flat = F.split(F.regexp_replace(raw, r"[\[\]\s]", ""), ",")
    return F.transform(flat, lambda item: try_cast(item, "double"))


def ingest_channel_sets(
    documents: DataFrame, preview_points: int = DEFAULT_PREVIEW_POINTS
) -> CurveTables:
    """Second-generation logs: JSON rows with scalar and list cells."""
    width = F.array_max(F.transform("rows", lambda row: F.size(row["cells"])))

    def channel(position: Column) -> Column:
        found = F.get("channel_set.Channel", position)
        mnemonic = first_text(
            found["Mnemonic"], F.concat(F.lit("CHANNEL_"), (position + 1).cast("string"))
        )
        lists = F.exists("rows", lambda row: F.startswith(F.get(row["cells"], position), F.lit("[")))
        return F.struct(
            channel_id(position + 1, mnemonic, F.col("dataset_id")).alias("channel_id"),
            mnemonic.alias("mnemonic"),
            first_text(found["Uom"], F.lit("")).alias("unit"),
            F.coalesce(lists, F.lit(False)).alias("is_array"),
        )

    none = F.array().cast("array<int>")
    places = F.when(F.col("width") > 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(none)
    measured = _with_index(_set_logs(documents)).withColumn("width", width)
    sets = cut_lineage(measured.withColumn("channels", F.transform(places, channel))).where(
        ~F.col("bad_shape") & (F.size("rows") > 0)
    )
    axis = _axis(sets)
    described = sets.select(*DATASET_KEYS, F.posexplode("channels").alias("position", "channel")).select(
        *DATASET_KEYS,
        "channel.channel_id",
        "position",
        "channel.mnemonic",
        F.coalesce("channel.unit", F.lit("")).alias("unit"),
        F.lit("Imported WITSML 2.x channel").alias("description"),
    )
    rows = sets.select(*DATASET_KEYS, "channels", "index_values", F.posexplode("rows").alias("ordinal", "row"))
    cells = rows.select(
        *DATASET_KEYS,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.get("index_values", F.col("ordinal")).alias("index"),
        F.col("row.cells").alias("cells"),
        F.posexplode("channels").alias("position", "channel"),
    ).select(
        *DATASET_KEYS,
        "channel.channel_id",
        "channel.is_array",
        "ordinal",
        "index",
        F.get("cells", F.col("position")).alias("raw"),
    )
    is_list = F.coalesce(F.startswith("raw", F.lit("[")), F.lit(False))
    array_samples = cells.where("is_array").select(
        *CHANNEL_KEYS,
        "ordinal",
        "index",
        F.when(is_list, nested_shape(F.col("raw"))).alias("shape"),
        F.when(is_list, nested_values(F.col("raw"))).alias("values"),
    )
    samples = _scalar_samples(cells.where(~F.col("is_array")))

    index = F.coalesce(
        F.get("channel_set.Index", F.lit(0)), F.get("channel_set.ChannelIndex", F.lit(0))
    )
    kind = log_index_kind(first_text(index["IndexType"], index["TimeDepth"], F.lit("Depth")))
    datasets = sets.select(
        *DATASET_KEYS,
        "position",
        first_text(
            "channel_set.Citation.Title",
            "channel_set.Title",
            "channel_set.Name",
            F.concat(F.lit("Channel set "), (F.col("set_index") + 1).cast("string")),
        ).alias("name"),
        F.lit("log").alias("kind"),
        first_text("item.WellName", F.lit("Unknown well")).alias("well_name"),
        F.lit("Imported wellbore").alias("wellbore_name"),
        first_text(index["Mnemonic"], F.lit("INDEX")).alias("index_mnemonic"),
        F.coalesce(non_empty(index["Uom"]), F.lit("")).alias("index_unit"),
        kind.alias("index_kind"),
        _reference_json("uuid", kind).alias("native_metadata"),
    )
    return _finish(datasets, described, axis, samples, array_samples, preview_points)


def ingest_trajectories(
    documents: DataFrame, preview_points: int = DEFAULT_PREVIEW_POINTS
) -> CurveTables:
    """Stations to a depth-indexed dataset; a field without any value is no channel."""
    fields = [*LOG_FIELD_NAMES, "trajectoryStation", "Station"]
    found = _objects_of(documents, "trajectory", "trajectory", fields)
    stations = F.coalesce("item.trajectoryStation", "item.Station")

    def measure(station: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(*[station[name] for name in names])

    def number(station: Column, names: tuple[str, ...]) -> Column:
        return try_cast(measure(station, names)["_VALUE"], "double")

    def numbers(names: tuple[str, ...]) -> Column:
        return F.transform(stations, lambda station: number(station, names))

    def last_unit(names: tuple[str, ...]) -> Column:
        units = F.transform(stations, lambda station: measure(station, names)["_uom"])
        return F.try_element_at(F.array_compact(units), F.lit(-1))

    values = {key: numbers(names) for key, names in STATION_FIELDS.items()}
    uoms = {key: last_unit(names) for key, names in STATION_FIELDS.items()}
    table = cut_lineage(
        found.select(
            "document_id",
            _dataset_id("dataset-witsml-trajectory", F.col("object_index") + 1).alias("dataset_id"),
            F.col("object_index").cast("int").alias("position"),
            "item",
            *[column.alias(f"{key}_values") for key, column in values.items()],
            *[F.coalesce(column, F.lit("")).alias(f"{key}_unit") for key, column in uoms.items()],
        )
    ).where(F.exists("MD_values", lambda value: value.isNotNull()))
    axis = table.select(*DATASET_KEYS, F.posexplode("MD_values").alias("ordinal", "raw")).select(
        *DATASET_KEYS,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        finite_number("raw").alias("index"),
        F.create_map(F.lit("value"), F.col("raw").cast("string")).alias("index_source"),
    )
    others = [key for key in STATION_FIELDS if key != "MD"]
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(key).alias("mnemonic"),
                    F.col(f"{key}_unit").alias("unit"),
                    F.col(f"{key}_values").alias("values"),
                )
                for key in others
            ]
        ),
        lambda entry: F.exists(entry["values"], lambda value: value.isNotNull()),
    )
    listed = table.select(*DATASET_KEYS, "MD_values", F.posexplode(entries).alias("position", "entry")).withColumn(
        "channel_id", channel_id(F.col("position") + 1, "entry.mnemonic", F.col("dataset_id"))
    )
    described = listed.select(
        *CHANNEL_KEYS,
        "position",
        "entry.mnemonic",
        "entry.unit",
        F.concat(F.lit("Trajectory "), "entry.mnemonic").alias("description"),
    )
    cells = listed.select(
        *CHANNEL_KEYS, "MD_values", F.posexplode("entry.values").alias("ordinal", "value")
    )
    samples = cells.select(
        *CHANNEL_KEYS,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        finite_number(F.get("MD_values", F.col("ordinal"))).alias("index"),
        finite_number("value").alias("value"),
        F.lit(None).cast("string").alias("text_value"),
    )
    datasets = table.select(
        *DATASET_KEYS,
        "position",
        first_text("item.name", "item.Citation.Title", F.lit("Trajectory")).alias("name"),
        F.lit("trajectory").alias("kind"),
        first_text("item.nameWell", "item.WellName", F.lit("Unknown well")).alias("well_name"),
        first_text("item.nameWellbore", F.lit("Imported wellbore")).alias("wellbore_name"),
        F.lit("MD").alias("index_mnemonic"),
        F.col("MD_unit").alias("index_unit"),
        F.lit("measured_depth").alias("index_kind"),
        F.to_json(F.struct(_native_id().alias("native_id"))).alias("native_metadata"),
    )
    return _finish(datasets, described, axis, samples, _no_arrays(samples), preview_points)


def strip_bulk_data(content: str | Column) -> Column:
    """XML text without channel data, log data and the data of channel sets."""
    text = F.col(content) if isinstance(content, str) else content
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    bulk = rf"(?is)<((?:[\w.-]+:)?(?:channelData|logData))\b{IN_TAG}(?:(?<=/)>|>.*?</\1\s*>)"
    text = F.regexp_replace(text, bulk, "")
    nested = rf"(?is)<((?:[\w.-]+:)?Data)\b{IN_TAG}>(?:\s*<\1\b{IN_TAG}>.*?</\1\s*>\s*|.*?)</\1\s*>"
    return F.regexp_replace(text, nested, "")


def xml_tags(documents: DataFrame) -> DataFrame:
    """Documents with ``tags``: their tags in order, each with depth, name, attributes and following text.

    Headers only, as the bulk data is removed first. ``is_start`` tells start tags, single
    ones included, from closing ones; ``started`` counts the tags that start at the depth
    of objects, up to and with this one.
    """
    body = F.regexp_replace(strip_bulk_data("content"), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    tag = F.lit(rf"(?s)<([^!?<>\s]{IN_TAG})>([^<]*)")
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, tag, 1).alias("mark"), F.regexp_extract_all(body, tag, 2).alias("text")
    )
    found = documents.where(F.col("problem").isNull()).select(
        "document_id", "file_name", "root_name", pairs.alias("pairs")
    )
    closes = lambda pair: F.startswith(pair["mark"], F.lit("/"))
    single = lambda pair: F.endswith(pair["mark"], F.lit("/")) & ~closes(pair)
    steps = F.transform("pairs", lambda pair: F.when(closes(pair), -1).when(single(pair), 0).otherwise(1))
    deep = found.withColumn(
        "depths",
        F.zip_with("pairs", running_sums(steps), lambda pair, sum_: sum_ + F.when(single(pair), 1).otherwise(0)),
    ).withColumn("level", F.when(F.endswith(F.lower("root_name"), F.lit("s")), 2).otherwise(1))
    starts = F.zip_with(
        "pairs", "depths", lambda pair, depth: F.when(~closes(pair) & (depth == F.col("level")), 1).otherwise(0)
    )

    def described(item: Column) -> Column:
        mark, start = item["pairs"]["mark"], ~closes(item["pairs"])
        return F.struct(
            item["depths"].alias("depth"),
            item["started"].alias("started"),
            start.alias("is_start"),
            F.regexp_extract(mark, r"^/?(?:[\w.-]+:)?([\w.-]+)", 1).alias("name"),
            F.when(start, mark).alias("attributes"),
            F.when(start & ~single(item["pairs"]), _unescape(strip(item["pairs"]["text"]))).alias("text"),
            F.concat(F.lit("<"), mark, F.lit(">"), item["pairs"]["text"]).alias("token"),
        )

    zipped = F.arrays_zip("pairs", "depths", running_sums(starts).alias("started"))
    return deep.select("document_id", "file_name", "root_name", "level", F.transform(zipped, described).alias("tags"))


def _unescape(text: Column) -> Column:
    # The five predefined entities, the ampersand last.
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def attribute(tag: str | Column, name: str) -> Column:
    """Non-empty value of one attribute of a start tag, else null."""
    pattern = rf"""(?:^|\s){name}\s*=\s*["']([^"']*)["']"""
    return F.nullif(F.regexp_extract(tag, pattern, 1), F.lit(""))


def reference_targets(tag: Column, wanted: str = r"(?i)(\w*uidref\w*|uuid)") -> Column:
    """Values of every attribute of a start tag whose local name is a reference."""
    pattern = rf"""(?:^|\s)(?:[\w.-]+:)?{wanted}\s*=\s*["']([^"']+)["']"""
    return F.regexp_extract_all(tag, F.lit(pattern), 2)


def reference_attributes(tags: DataFrame, keys: list[str], tag: str = "attributes",
                         wanted: str = r"(?i)(\w*uidref\w*|uuid)") -> DataFrame:
    """(keys, name, target) of every attribute whose local name is a reference."""
    return tags.select(
        *keys, "name", F.explode(reference_targets(F.col(tag), wanted)).alias("target")
    ).distinct()


@dataclass(frozen=True)
class ObjectTables:
    objects: DataFrame
    relationships: DataFrame
    well_names: DataFrame


def ingest_objects(documents: DataFrame) -> ObjectTables:
    """Preserved objects of every document, their edges and the well names they give."""
    documents = xml_tags(documents)
    # The tags of an object begin where it starts and end before the next one does.
    started = F.col("tags.started")
    earlier = F.concat(F.array(F.lit(0)), F.slice(started, F.lit(1), F.greatest(F.size("tags") - 1, F.lit(0))))
    begins = F.array_compact(
        F.transform(
            F.arrays_zip(started.alias("now"), earlier.alias("before")),
            lambda item, at: F.when(item["now"] > item["before"], at),
        )
    )
    # Outer, for a plain explode would have the optimizer test the size of its array below all the parsing.
    objects_in = documents.withColumn("begins", begins).select(
        "document_id",
        "level",
        "tags",
        "begins",
        F.posexplode_outer("begins").alias("object_index", "begin"),
    ).where(F.col("object_index").isNotNull())
    end = F.coalesce(F.get("begins", F.col("object_index") + 1), F.size("tags"))
    own = F.slice("tags", F.col("begin") + 1, end - F.col("begin"))
    deep_enough = lambda tag: tag["depth"] >= F.col("level") - F.when(tag["is_start"], 0).otherwise(1)
    inside = objects_in.select("document_id", "object_index", F.filter(own, deep_enough).alias("tags"))
    keys = ["document_id", "object_index"]

    def first_where(field: str, condition: Callable[[Column], Column]) -> Column:
        return F.get(F.filter("tags", lambda tag: tag["is_start"] & condition(tag["name"])), F.lit(0))[field]

    facts = inside.select(
        *keys,
        F.get("tags", F.lit(0))["name"].alias("object_type"),
        F.get("tags", F.lit(0))["attributes"].alias("head"),
        first_where("text", lambda name: name == "Uuid").alias("uuid_text"),
        first_where("text", lambda name: F.lower(name).isin("name", "title")).alias("name_text"),
        first_where("text", lambda name: F.lower(name).isin("namewell", "wellname", "name")).alias("well_text"),
        first_where("attributes", lambda name: name == "Wellbore").alias("wellbore_tag"),
        first_where("attributes", lambda name: name == "Well").alias("well_tag"),
        F.array_join(F.transform("tags", lambda tag: tag["token"]), "").alias("payload"),
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter("tags", lambda tag: tag["is_start"]),
                    lambda tag: F.transform(
                        reference_targets(tag["attributes"]),
                        lambda target: F.struct(tag["name"].alias("name"), target.alias("target")),
                    ),
                )
            )
        ).alias("references"),
    )
    native = F.coalesce(
        *[attribute("head", name) for name in ("uuid", "uid", "uidWell", "uidWellbore")],
        non_empty("uuid_text"),
        F.concat("object_type", F.lit("-"), (F.col("object_index") + 1).cast("string")),
    )
    parent = F.coalesce(
        attribute("head", "uidWellbore"),
        attribute("head", "uidWell"),
        *[attribute("wellbore_tag", name) for name in ("uuid", "uidRef", "uid")],
        *[attribute("well_tag", name) for name in ("uuid", "uidRef", "uid")],
    )
    identified = facts.withColumn("native_id", native).select(
        "*",
        F.format_string(
            "witsml-object-1-%d-%s", F.col("object_index") + 1, F.left("document_id", F.lit(8))
        ).alias("id"),
        parent.alias("parent_native_id"),
    )
    identified = cut_lineage(identified)
    objects = identified.select(
        "document_id",
        "id",
        "object_type",
        "native_id",
        F.coalesce(non_empty("name_text"), "native_id").alias("name"),
        "parent_native_id",
        F.format_string(
            "metadata/witsml/objects/001-%03d-%s.xml", F.col("object_index") + 1, slug("object_type")
        ).alias("metadata_path"),
        "payload",
    )
    parents = identified.where(F.col("parent_native_id").isNotNull()).select(
        "document_id",
        F.col("id").alias("source_object_id"),
        F.col("parent_native_id").alias("target_native_id"),
        F.lit("parent").alias("relationship_type"),
    )
    references = identified.select("document_id", "id", F.explode("references").alias("reference")).select(
        "document_id",
        F.col("id").alias("source_object_id"),
        F.col("reference.target").alias("target_native_id"),
        F.col("reference.name").alias("relationship_type"),
    )
    wells = identified.select(
        "document_id", F.col("object_index").alias("position"), F.col("well_text").alias("name")
    )
    return ObjectTables(objects, parents.unionByName(references), wells)


def source_rows(documents: DataFrame, well_names: DataFrame) -> DataFrame:
    """Source table: versions joined, field named after the first well."""
    usable = documents.where(F.col("problem").isNull())
    named = F.when(F.coalesce(F.trim("name"), F.lit("")) != "", F.col("position"))
    wells = well_names.groupBy("document_id").agg(F.min_by("name", named).alias("well"))
    return usable.join(wells, "document_id", "left").select(
        "document_id",
        "file_name",
        F.lit("WITSML").alias("source_format"),
        F.col("version").alias("source_version"),
        "file_size_bytes",
        F.coalesce("well", file_stem("file_name")).alias("field_name"),
    )
