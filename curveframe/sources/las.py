"""LAS text files to the canonical tables.

A *part* is a row with whole data rows of one file: their cells in reading order and
the number of the first row. A file of moderate size is one part, made from its text
in place; larger files come as lines and are cut into parts (``las_lines``). Columns
are typed, index candidates scored and the index chosen inside the part, so the
index stands beside the cells when these are exploded, and no cell is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curveframe.functions.numeric import finite_or_null, is_finite, nan_to_null, try_cast
from curveframe.functions.timeindex import date_time_epoch
from curveframe.functions.text import (
    channel_id,
    file_stem,
    first_text,
    non_empty,
    squish,
    strip,
    suffix,
)
from curveframe.operators.index_selection import (
    candidate_facts,
    candidate_structs,
    candidate_warnings,
    chosen_candidate,
    text_positions,
    unique_column_names,
)
from curveframe.operators.stats import curve_statistics, even_positions, index_extent, text_statistics
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS, DEFAULT_PREVIEW_POINTS
from curveframe.session import cut_lineage
from curveframe.sources import registry

# Messages of files that cannot be used.
NOT_LAS = "Only LAS files are supported in this import step."
NO_CURVES = "The LAS file does not define any curves."
NO_TABLE = "The LAS file does not contain a readable data table."
NO_INDEX = "The LAS file does not contain a credible numeric or DATE/TIME index."
NO_OTHER_CURVES = "The LAS file does not contain any curves besides the depth index."
NO_DESCRIPTION = "Imported LAS curve"
CHOOSE_INDEX = "This LAS file has multiple credible index curves. Select the index to use."
UNKNOWN_CHOICE = "The selected LAS index candidate is no longer available. Reopen the file."

# Larger files are read by line; parts of them hold about so many cells.
WHOLE_BYTES = 64 << 20
PART_CELLS = 1 << 18

# Length that stands for "to the end" in a slice.
ALL = 1 << 30

# A colon inside a clock time or an address does not part value and description; of the others the last does.
PARTING = r":(?!//)(?!(?<=\d:)\d\d)"
HEADER_LINE = rf"^\s*([^.:]*?)\s*\.(\S*)\s*(.*?)\s*(?:{PARTING}\s*((?:(?!{PARTING}).)*?))?\s*$"
# The only well items whose value comes before the colon in version 1.2 files.
VALUE_FIRST = ("STRT", "STOP", "STEP", "NULL")


@dataclass(frozen=True)
class LasTables:
    """Canonical tables of a set of LAS documents; ``status`` has one row per file."""

    sources: DataFrame
    datasets: DataFrame
    channels: DataFrame
    axis: DataFrame
    samples: DataFrame
    preview_samples: DataFrame
    preserved_objects: DataFrame
    candidates: DataFrame
    status: DataFrame
    warnings: DataFrame


# Section letters and the columns of a parsed file that hold their lines.
SECTION_LINES = {"V": "version_lines", "W": "well_lines", "C": "curve_lines", "P": "parameter_lines", "O": "other_lines"}
BLANK_LINE = r"^\s*(#.*)?$"


def _section_lines(letter: str) -> Column:
    """Lines of the first section whose title starts with the letter, title dropped."""
    sections = F.filter("sections", lambda text: F.upper(F.left(text, F.lit(1))) == letter)
    text = F.regexp_replace(F.get(sections, F.lit(0)), r"(\r\n|\n|\r)\z", "")
    lines = F.split(text, r"\r\n|\n|\r")
    return F.coalesce(F.slice(lines, F.lit(2), F.lit(ALL)), F.array().cast("array<string>"))


def content_lines(lines: str | Column) -> Column:
    return F.filter(lines, lambda line: ~F.rlike(line, F.lit(BLANK_LINE)))


def _header_items(letter: str) -> Column:
    def item(line: Column) -> Column:
        part = lambda group: F.regexp_extract(line, HEADER_LINE, group)
        return F.struct(
            part(1).alias("mnemonic"),
            part(2).alias("unit"),
            part(3).alias("value"),
            part(4).alias("description"),
        )

    return F.transform(content_lines(SECTION_LINES[letter]), item)


def _well_items() -> Column:
    """Well items; versions before 2 write description and value of most of them the other way round."""
    old = _header_value("version_items", "VERS", F.lit("2.0")).try_cast("double") < 2

    def turned(item: Column) -> Column:
        return F.struct(
            item["mnemonic"].alias("mnemonic"),
            item["unit"].alias("unit"),
            item["description"].alias("value"),
            item["value"].alias("description"),
        )

    return F.transform(
        _header_items("W"),
        lambda item: F.when(old & ~F.upper(item["mnemonic"]).isin(*VALUE_FIRST), turned(item)).otherwise(item),
    )


def _header_value(items: str, mnemonic: str, fallback: Column) -> Column:
    found = F.filter(items, lambda item: F.upper(item["mnemonic"]) == mnemonic)
    return first_text(F.get(found, F.lit(0))["value"], fallback)


def line_tokens(line: Column, delimiter: str | Column) -> Column:
    """Cells of one data line."""
    delimiter = F.col(delimiter) if isinstance(delimiter, str) else delimiter
    blank = F.split(F.btrim(F.regexp_replace(line, r"\s+", " ")), " ")

    def separated(pattern: str) -> Column:
        return F.transform(F.split(line, pattern, -1), strip)

    return F.when(delimiter == "COMMA", separated(",")).when(delimiter == "TAB", separated("\t")).otherwise(blank)


def with_header(files: DataFrame) -> DataFrame:
    """Adds items, delimiter and names to files whose header lines are known."""
    return (
        files.withColumn("version_items", _header_items("V"))
        .withColumn("well_items", _well_items())
        .withColumn("curve_items", _header_items("C"))
        .withColumn("parameter_items", _header_items("P"))
        .withColumn("other", F.array_join("other_lines", "\n"))
        .withColumn("delimiter", F.upper(_header_value("version_items", "DLM", F.lit("SPACE"))))
        .withColumn("curve_count", F.size("curve_items"))
        .withColumn("version", _header_value("version_items", "VERS", F.lit("unknown")))
        .withColumn("well_name", _header_value("well_items", "WELL", file_stem("file_name")))
        .withColumn("field_name", _header_value("well_items", "FLD", F.lit("Unknown field")))
        .withColumn("null_text", _header_value("well_items", "NULL", F.lit("")))
        .withColumn("dataset_id", F.concat(F.lit("dataset-las-"), F.left("document_id", F.lit(12))))
        .drop(*SECTION_LINES.values())
    )


def file_problem(cells: Column) -> Column:
    """Why a file with so many cells cannot be used, else null."""
    ragged = (cells == 0) | (cells % F.greatest("curve_count", F.lit(1)) != 0)
    return (
        F.when(suffix("file_name") != ".las", NOT_LAS)
        .when(F.col("curve_count") == 0, NO_CURVES)
        .when(ragged, NO_TABLE)
    )


def parse_las(raw: DataFrame) -> DataFrame:
    """Header items, curve definitions and data cells of each file, as its only part.

    Nothing here filters on parsed columns: such a filter would move below the
    parsing and repeat it.
    """
    sections = F.split("content", r"(?m)^[ \t]*~", -1)
    readable = suffix("file_name") == ".las"
    cut = raw.withColumn("content", F.when(readable, F.col("content")).otherwise("")).withColumn(
        "sections", F.slice(sections, F.lit(2), F.lit(ALL))
    )
    for letter, name in SECTION_LINES.items():
        cut = cut.withColumn(name, _section_lines(letter))
    data = cut.withColumn("data_lines", content_lines(_section_lines("A")))
    # Cells parted by blanks may stand in any number of lines: all are split at once.
    joined = F.split(F.btrim(F.regexp_replace(F.array_join("data_lines", " "), r"\s+", " ")), " ")
    by_line = F.flatten(F.transform("data_lines", lambda line: line_tokens(line, "delimiter")))
    tokens = F.when(F.size("data_lines") == 0, F.array().cast("array<string>")).otherwise(
        F.when(F.col("delimiter").isin("COMMA", "TAB"), by_line).otherwise(joined)
    )
    return (
        with_header(data)
        .withColumn("tokens", tokens)
        .withColumn("part", F.lit(0).cast("bigint"))
        .withColumn("first_row", F.lit(0).cast("bigint"))
        .withColumn("problem", file_problem(F.size("tokens")))
        .drop("sections", "content", "data_lines")
    )


def header_items(parsed: DataFrame) -> DataFrame:
    """(document, section, position, mnemonic, unit, value, description) rows."""
    first = parsed.where(F.col("part") == 0)
    parts = [
        first.select(
            "document_id",
            F.lit(section).alias("section"),
            F.posexplode(f"{section}_items").alias("position", "item"),
        )
        for section in ("version", "well", "curve", "parameter")
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select("document_id", "section", "position", "item.*")


def _sentinel() -> Column:
    return try_cast(F.col("null_text"), "double")


def _value(number: Column, sentinel: Column) -> Column:
    """A cell's number, null for the null sentinel of the header."""
    return F.when(sentinel.isNull() | (number != sentinel), nan_to_null(number))


def las_cells(parsed: DataFrame) -> DataFrame:
    """One row per data cell: (dataset, position, ordinal, raw, value).

    The null sentinel of the header becomes a null value.
    """
    tokens = F.when(F.col("problem").isNull(), F.col("tokens"))
    cells = parsed.select(
        *DATASET_KEYS,
        "curve_count",
        "first_row",
        _sentinel().alias("sentinel"),
        F.posexplode_outer(tokens).alias("place", "token"),
    ).where(F.col("place").isNotNull())
    raw = F.nullif("token", F.lit(""))
    return cells.select(
        *DATASET_KEYS,
        (F.col("place") % F.col("curve_count")).alias("position"),
        (F.col("first_row") + F.floor(F.col("place") / F.col("curve_count"))).alias("ordinal"),
        raw.alias("raw"),
        _value(try_cast(raw, "double"), F.col("sentinel")).alias("value"),
    )


def with_facts(parts: DataFrame) -> DataFrame:
    """Adds the cells as numbers, the columns that hold text, and what each part says about index candidates."""
    usable = F.when(F.col("problem").isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>"))
    numbered = (
        parts.withColumn("tokens", usable)
        .withColumn("sentinel", _sentinel())
        .withColumn("numbers", F.transform("tokens", lambda token: try_cast(F.nullif(token, F.lit("")), "double")))
    )
    mnemonics = F.transform("curve_items", lambda item: item["mnemonic"])
    return (
        numbered.withColumn("mnemonics", mnemonics)
        .withColumn("row_count", F.floor(F.size("tokens") / F.greatest("curve_count", F.lit(1))))
        .withColumn("text_positions", text_positions("tokens", "numbers", "curve_count"))
        .withColumn("facts", candidate_facts("tokens", "numbers", "mnemonics", "curve_count", _value))
        .drop("mnemonics")
    )


def with_index(parts: DataFrame, selection: DataFrame | None, take_first: bool) -> DataFrame:
    """Adds curves, candidates, the choice, and the index of each row of the part."""
    if selection is None:
        asked = parts.withColumn("requested", F.lit(None).cast("string"))
    else:
        wanted = selection.select(*DATASET_KEYS, F.col("candidate_id").alias("requested"))
        asked = parts.join(wanted, DATASET_KEYS, "left")

    def curve(item: Column, place: Column) -> Column:
        name = F.coalesce(non_empty(item["mnemonic"]), F.concat(F.lit("CURVE_"), place.cast("string")))
        return F.struct(
            place.alias("position"),
            name.alias("mnemonic"),
            F.trim(item["unit"]).alias("unit"),
            F.coalesce(non_empty(item["description"]), F.lit(NO_DESCRIPTION)).alias("description"),
            (~F.array_contains("text_positions", place)).alias("is_numeric"),
        )

    curves = F.when(F.col("problem").isNull(), F.transform("curve_items", curve))
    chosen = F.col("choice.candidate")
    is_other = lambda item: (
        (item["position"] != chosen["source_position"])
        & (item["position"] != F.coalesce(chosen["date_position"], F.lit(-1)))
    )
    channel_ids = F.transform(
        "curves", lambda item: F.when(is_other(item), channel_id(item["position"], item["mnemonic"]))
    )
    picked = (
        asked.withColumn("curves", curves)
        .withColumn("candidates", candidate_structs("facts", "curves", "row_count"))
        .withColumn("choice", chosen_candidate("candidates", "requested", take_first))
    )
    ready = F.col("choice.status") == "OK"
    rows = F.sequence(F.lit(0), F.floor(F.size("tokens") / F.col("curve_count")).cast("int") - 1)
    width = F.col("curve_count")

    def paired(row: Column) -> Column:
        return date_time_epoch(
            F.get("tokens", row * width + chosen["date_position"]), F.get("tokens", row * width + chosen["source_position"])
        )

    def numeric(row: Column) -> Column:
        return _value(F.get("numbers", row * width + chosen["source_position"]), F.col("sentinel")) * chosen["factor"]

    def index(row: Column) -> Column:
        # An index cell without a number stays NaN, as the raw table would have it.
        return F.coalesce(F.when(chosen["date_position"].isNotNull(), paired(row)).otherwise(numeric(row)), F.lit(float("nan")))

    return picked.withColumn("channel_ids", F.when(ready, channel_ids)).withColumn(
        "index_values", F.when(ready & (F.size("tokens") > 0), F.transform(rows, index))
    )


def ingest_las(
    raw: DataFrame,
    selection: DataFrame | None = None,
    take_first: bool = False,
    preview_points: int = DEFAULT_PREVIEW_POINTS,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> LasTables:
    """Canonical tables of raw LAS documents, each a row with the text of one file.

    ``take_first`` resolves an ambiguous index like a preview would; else such
    files wait for a selection.
    """
    return las_tables(with_facts(parse_las(raw)), selection, take_first, preview_points, stage)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    selection: DataFrame | None = None,
    take_first: bool = False,
    preview_points: int = DEFAULT_PREVIEW_POINTS,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
    whole_bytes: int = WHOLE_BYTES,
    part_cells: int = PART_CELLS,
) -> LasTables:
    """Canonical tables of a folder: files up to ``whole_bytes`` as one row, larger ones by line and split."""
    from curveframe.sources import las_lines

    size = F.col("_metadata.file_size")
    small = registry.read_text_documents(spark, folder, "*.las", size <= whole_bytes)
    lines = registry.read_text_lines(spark, folder, "*.las", size > whole_bytes)
    parts = with_facts(parse_las(small))
    large = las_lines.parts_of_lines(lines, stage, part_cells).select(parts.columns)
    return las_tables(parts.unionByName(large), selection, take_first, preview_points, stage)


def las_tables(
    parts: DataFrame,
    selection: DataFrame | None,
    take_first: bool,
    preview_points: int,
    stage: Callable[[DataFrame], DataFrame],
) -> LasTables:
    """``stage`` keeps the parts with their index, and the headers apart from the cells."""
    texts = stage(with_index(parts, selection, take_first))
    parsed = stage(texts.where(F.col("part") == 0).drop("tokens", "numbers", "index_values"))
    candidates = parsed.select(*DATASET_KEYS, F.explode("candidates").alias("candidate")).select(
        *DATASET_KEYS, "candidate.*"
    )
    choice = parsed.where(F.col("choice").isNotNull()).select(
        *DATASET_KEYS, F.col("choice.status").alias("status"), "choice.candidate.*"
    )
    chosen = choice.where(F.col("status") == "OK").select(
        *DATASET_KEYS,
        "date_position",
        F.col("mnemonic").alias("index_mnemonic"),
        F.col("unit").alias("index_unit"),
        F.col("kind").alias("index_kind"),
        "time_reference",
    )

    index = F.col("choice.candidate")
    place = F.col("row") * F.col("curve_count")
    axis = texts.select(
        *DATASET_KEYS,
        "first_row",
        "tokens",
        "curve_count",
        index["kind"].alias("kind"),
        index["source_position"].alias("source_position"),
        index["date_position"].alias("date_position"),
        F.posexplode("index_values").alias("row", "index"),
    ).select(
        *DATASET_KEYS,
        (F.col("first_row") + F.col("row")).alias("ordinal"),
        "index",
        F.when(
            F.col("date_position").isNotNull(),
            F.create_map(
                F.lit("time"), F.get("tokens", place + F.col("source_position")),
                F.lit("date"), F.get("tokens", place + F.col("date_position")),
            ),
        )
        .when(F.col("kind") == "time", F.create_map(F.lit("value"), F.get("tokens", place + F.col("source_position"))))
        .alias("index_source"),
    )

    kept = parsed.select(*DATASET_KEYS, F.explode(F.arrays_zip("curves", "channel_ids")).alias("entry")).where(
        F.col("entry.channel_ids").isNotNull()
    ).select(
        *DATASET_KEYS,
        F.col("entry.channel_ids").alias("channel_id"),
        F.col("entry.curves.position").alias("source_position"),
        "entry.curves.mnemonic",
        "entry.curves.unit",
        "entry.curves.description",
        "entry.curves.is_numeric",
    )
    order = Window.partitionBy(*DATASET_KEYS).orderBy("source_position")
    named = unique_column_names(
        kept.withColumn("position", F.row_number().over(order) - 1),
        position="source_position",
    )

    # Cells keep their place; channel, type and index stand beside them at the same place or row.
    column = F.col("place") % F.col("curve_count")
    row = F.floor(F.col("place") / F.col("curve_count"))
    cells = (
        texts.where(F.col("choice.status") == "OK")
        .select(
            *DATASET_KEYS,
            *["curve_count", "first_row", "row_count", "sentinel", "index_values", "channel_ids", "numbers", "text_positions"],
            F.posexplode("tokens").alias("place", "token"),
        )
        .where(F.get("channel_ids", column).isNotNull())
        .select(
            *DATASET_KEYS,
            F.get("channel_ids", column).alias("channel_id"),
            (F.col("first_row") + row).alias("ordinal"),
            F.get("index_values", row.cast("int")).alias("index"),
            F.array_contains("text_positions", column).alias("is_text"),
            _value(F.get("numbers", F.col("place")), F.col("sentinel")).alias("value"),
            F.nullif("token", F.lit("")).alias("token"),
            "row_count",
        )
    )
    typed = cells.select(
        *CHANNEL_KEYS,
        "ordinal",
        "index",
        F.when(~F.col("is_text"), F.col("value")).alias("value"),
        F.when(F.col("is_text"), F.col("token")).alias("text_value"),
        "is_text",
        "row_count",
    )
    samples = typed.drop("is_text", "row_count")

    figures = curve_statistics(samples)
    # Rows are numbered without gaps, so the rows of a preview are known by their number.
    previewed = typed.where(
        ~F.col("is_text") & is_finite("index") & even_positions(F.col("ordinal"), F.col("row_count"), preview_points)
    )
    preview_order = Window.partitionBy(*CHANNEL_KEYS).orderBy("row")
    previews = previewed.select(
        *CHANNEL_KEYS, F.col("ordinal").alias("row"), F.col("index").alias("index_value"), finite_or_null("value").alias("value")
    ).select(*CHANNEL_KEYS, (F.row_number().over(preview_order) - 1).alias("ordinal"), "index_value", "value")
    # A preview counts blank, nan and none texts; a conversion stores no text nulls.
    text_nulls = text_statistics(samples).select(
        *CHANNEL_KEYS,
        F.col("null_count").alias("text_nulls") if take_first else F.lit(0).alias("text_nulls"),
    )
    channels = named.join(
        figures.select(*CHANNEL_KEYS, "minimum", "maximum", "sample_count", "null_count"),
        CHANNEL_KEYS,
    ).join(text_nulls, CHANNEL_KEYS).select(
        *CHANNEL_KEYS,
        F.col("position").cast("int").alias("position"),
        "mnemonic",
        "unit",
        "description",
        "minimum",
        "maximum",
        "sample_count",
        F.when(F.col("is_numeric"), F.col("null_count"))
        .otherwise(F.col("text_nulls"))
        .alias("null_count"),
        F.array().cast("array<int>").alias("sample_shape"),
        F.lit("parquet").alias("storage_kind"),
        F.when(F.col("is_numeric"), "numeric").otherwise("text").alias("data_type"),
        F.concat(F.lit("data/scalar/"), "dataset_id", F.lit(".parquet")).alias("asset_path"),
        F.to_json(F.struct(F.col("column_name").alias("parquet_column"))).alias("native_metadata"),
    )

    extent = index_extent(axis)
    facts = parsed.select("document_id", "version", "well_name", "null_text")
    source_columns = F.when(
        F.col("date_position").isNotNull(),
        F.create_map(F.lit("TIME"), F.lit("source_time"), F.lit("DATE"), F.lit("source_date")),
    ).when(
        F.col("index_kind") == "time",
        F.create_map("index_mnemonic", F.concat(F.lit("source_"), F.lower("index_mnemonic"))),
    ).otherwise(F.create_map().cast("map<string,string>"))
    with_curves = named.select(*DATASET_KEYS).distinct()
    datasets = (
        chosen.join(extent.where(F.col("finite_count") > 0), DATASET_KEYS)
        .join(with_curves, DATASET_KEYS, "left_semi")
        .join(facts, "document_id")
        .select(
            *DATASET_KEYS,
            F.lit(0).alias("position"),
            F.concat(F.lit("LAS "), "version").alias("name"),
            F.lit("log").alias("kind"),
            "well_name",
            F.lit("Imported wellbore").alias("wellbore_name"),
            "row_count",
            "index_mnemonic",
            "index_unit",
            "index_kind",
            "index_minimum",
            "index_maximum",
            F.to_json(
                F.struct(
                    F.col("null_text").alias("null_value"),
                    source_columns.alias("source_index_columns"),
                    F.col("time_reference").alias("time_index_reference"),
                )
            ).alias("native_metadata"),
        )
    )

    sources = parsed.where(F.col("problem").isNull()).select(
        "document_id",
        "file_name",
        F.lit("LAS").alias("source_format"),
        F.col("version").alias("source_version"),
        "file_size_bytes",
        "field_name",
    )
    objects = parsed.where(F.col("problem").isNull()).select(
        "document_id",
        F.concat(F.lit("object-las-"), F.left("document_id", F.lit(12))).alias("id"),
        F.lit("LAS_HEADER").alias("object_type"),
        F.col("file_name").alias("native_id"),
        F.col("well_name").alias("name"),
        F.lit(None).cast("string").alias("parent_native_id"),
        F.lit("metadata/las/header.json").alias("metadata_path"),
        F.to_json(
            F.struct(
                F.col("version_items").alias("version"),
                F.col("well_items").alias("well"),
                F.col("curve_items").alias("curves"),
                F.col("parameter_items").alias("parameters"),
                "other",
            )
        ).alias("payload"),
    )
    return LasTables(
        sources=sources,
        datasets=datasets,
        channels=channels,
        axis=axis,
        samples=samples,
        preview_samples=previews,
        preserved_objects=objects,
        candidates=candidates,
        status=_status(parsed, choice, with_curves),
        warnings=candidate_warnings(choice),
    )


def _status(parsed: DataFrame, choice: DataFrame, with_curves: DataFrame) -> DataFrame:
    """One row per file: OK, a failure with its message, or the wait for a choice."""
    decided = choice.select("document_id", F.col("status").alias("choice_status"))
    usable = with_curves.select("document_id", F.lit(True).alias("has_curves"))
    message = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("choice_status").isNull(), NO_INDEX)
        .when(F.col("choice_status") == "INDEX_SELECTION_REQUIRED", CHOOSE_INDEX)
        .when(F.col("choice_status") == "INDEX_CANDIDATE_UNKNOWN", UNKNOWN_CHOICE)
        .when(F.col("has_curves").isNull(), NO_OTHER_CURVES)
    )
    return (
        parsed.select("document_id", "file_name", "problem")
        .join(decided, "document_id", "left")
        .join(usable, "document_id", "left")
        .select(
            "document_id",
            "file_name",
            F.when(F.col("choice_status") == "INDEX_SELECTION_REQUIRED", F.col("choice_status"))
            .when(message.isNull(), "OK")
            .otherwise("FAILED")
            .alias("status"),
            message.alias("message"),
        )
    )

