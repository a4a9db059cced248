"""Catalog questions: summaries, searches, object details and view settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.text import contains_words, like_anywhere, suffix
from curveframe.functions.timeindex import default_display_mode, time_reference
from curveframe.operators.paging import SortedPages
from curveframe.schema import DATASET_KEYS, MAX_DETAIL_BYTES


def metadata_map(json_text: str | Column) -> Column:
    """JSON object as a text map; anything else reads as an empty map."""
    parsed = F.from_json(
        F.col(json_text) if isinstance(json_text, str) else json_text, "map<string,string>"
    )
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def is_scalar() -> Column:
    return (F.col("storage_kind") == "parquet") & (F.size("sample_shape") == 0)


def is_displayable(preview_count: str | None = None) -> Column:
    """Scalar curve with a known extreme or at least one preview sample."""
    shown = F.col("minimum").isNotNull() | F.col("maximum").isNotNull()
    if preview_count is not None:
        shown = shown | (F.coalesce(F.col(preview_count), F.lit(0)) > 0)
    return is_scalar() & shown


def search_curves(channels: DataFrame, term: str) -> DataFrame:
    """Channels whose mnemonic, description or unit contain the term; all for a blank one."""
    if not term.strip():
        return channels
    return channels.where(contains_words(term, "mnemonic", "description", "unit"))


def search_objects(objects: DataFrame, term: str | None) -> DataFrame:
    if not term:
        return objects
    return objects.where(like_anywhere(term, "name", "object_type", "native_id"))


OBJECT_ORDER = ["object_type", "name", "id"]
OBJECT_FIELDS = ["id", "object_type", "native_id", "name", "parent_native_id"]
# A page that ends within so many rows is found by top-k, which Spark does before it shuffles.
SHALLOW_ROWS = 1000


def object_page(objects: DataFrame, page: int, page_size: int, term: str | None = None) -> DataFrame:
    """One page of matching objects, ordered by type, name and id."""
    found = search_objects(objects, term)
    start, end = page * page_size, (page + 1) * page_size
    if end <= SHALLOW_ROWS:
        return found.orderBy(*OBJECT_ORDER).offset(start).limit(page_size).select(*OBJECT_FIELDS)
    everything = found.select(*OBJECT_FIELDS).withColumn("all", F.lit(0))
    deep = SortedPages(everything, ["all"], OBJECT_ORDER).page(start, end)
    return deep.orderBy("place").select(*OBJECT_FIELDS)


def object_pages_by_document(
    objects: DataFrame, page: int, page_size: int, term: str | None = None
) -> DataFrame:
    """``object_page`` of every document at once, with the document's match total."""
    found = search_objects(objects, term).select("document_id", *OBJECT_FIELDS)
    start, end = page * page_size, (page + 1) * page_size
    fields = ["document_id", "place", "total", *OBJECT_FIELDS]
    if end > SHALLOW_ROWS:
        return SortedPages(found, ["document_id"], OBJECT_ORDER).page(start, end).select(*fields)
    totals = found.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("document_id").orderBy(*OBJECT_ORDER)
    placed = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= end)
    return placed.where(F.col("place") > start).join(totals, "document_id").select(*fields)


def object_details(objects: DataFrame) -> DataFrame:
    """Payload cut to 256 KiB, whether it was cut, and how to read it.

    Expects ``metadata_path`` and ``payload``; the cut is made on UTF-8 bytes.
    """
    raw = F.encode("payload", "UTF-8")
    size = F.octet_length("payload")
    truncated = size > MAX_DETAIL_BYTES
    head = F.make_valid_utf8(F.substring(raw, 1, MAX_DETAIL_BYTES).cast("string"))
    text = F.when(truncated, head).otherwise(F.col("payload"))
    kind = suffix("metadata_path")
    is_json = (kind == ".json") & ~truncated
    document = F.rlike("payload", F.lit(r"^\s*[\[{]")) & F.try_parse_json("payload").isNotNull()
    return objects.select(
        "id",
        "object_type",
        "native_id",
        "name",
        "parent_native_id",
        "metadata_path",
        F.when(is_json & document, "application/json")
        .when(kind == ".xml", "application/xml")
        .otherwise("text/plain")
        .alias("content_type"),
        F.when(is_json & document, F.col("payload")).alias("content_json"),
        F.when(~(is_json & document), text).alias("text"),
        size.cast("bigint").alias("size_bytes"),
        truncated.alias("truncated"),
    )


def latest_settings(settings: DataFrame) -> DataFrame:
    """The newest settings row of each dataset.

    Of rows with one version the one that sorts last counts, by every column in turn, so
    that the answer does not depend on the order in which they are read.
    """
    rest = [name for name in settings.columns if name not in (*DATASET_KEYS, "version")]
    newest = F.max(F.struct("version", *rest)).alias("newest")
    return settings.groupBy(*DATASET_KEYS).agg(newest).select(
        *DATASET_KEYS, *[F.col(f"newest.{name}").alias(name) for name in settings.columns if name not in DATASET_KEYS]
    )


def default_settings(datasets: DataFrame) -> DataFrame:
    """Settings a dataset starts with: clock time only for absolute time indexes."""
    reference = time_reference(metadata_map("native_metadata")["time_index_reference"])
    return datasets.select(
        *DATASET_KEYS,
        default_display_mode(reference).alias("time_display_mode"),
        F.lit("utc").alias("time_zone"),
        F.lit(None).cast("double").alias("manual_anchor_index"),
        F.lit(None).cast("double").alias("manual_anchor_timestamp"),
        F.lit(0).cast("bigint").alias("version"),
    )


def upsert_settings(settings: DataFrame, updates: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Insert or replace by dataset; the higher version wins.

    With ``datasets``, updates of datasets that do not exist change nothing; they are
    the rows of ``unknown_setting_targets``.
    """
    known = updates if datasets is None else updates.join(datasets.select(*DATASET_KEYS), DATASET_KEYS, "left_semi")
    return latest_settings(settings.unionByName(known))


def unknown_setting_targets(updates: DataFrame, datasets: DataFrame) -> DataFrame:
    """Updates of datasets that do not exist, as error rows."""
    return (
        updates.join(datasets.select(*DATASET_KEYS), DATASET_KEYS, "left_anti")
        .select(*DATASET_KEYS)
        .distinct()
        .withColumn("message", F.concat(F.lit("Dataset "), "dataset_id", F.lit(" was not found.")))
    )


def effective_settings(datasets: DataFrame, settings: DataFrame) -> DataFrame:
    """Stored settings of each dataset, else its defaults."""
    stored = latest_settings(settings).withColumn("stored", F.lit(True))
    defaults = default_settings(datasets).select(
        *DATASET_KEYS, F.col("time_display_mode").alias("default_mode")
    )
    return defaults.join(stored, DATASET_KEYS, "left").select(
        *DATASET_KEYS,
        F.coalesce("time_display_mode", "default_mode").alias("time_display_mode"),
        F.coalesce("time_zone", F.lit("utc")).alias("time_zone"),
        "manual_anchor_index",
        "manual_anchor_timestamp",
    )


def dataset_overview(
    datasets: DataFrame, channels: DataFrame, previews: DataFrame, settings: DataFrame
) -> DataFrame:
    """One flat row per dataset with its curve counts and settings."""
    preview_counts = previews.groupBy(*DATASET_KEYS, "channel_id").agg(
        F.count(F.lit(1)).alias("preview_count")
    )
    counts = (
        channels.join(preview_counts, [*DATASET_KEYS, "channel_id"], "left")
        .groupBy(*DATASET_KEYS)
        .agg(
            F.count(F.lit(1)).alias("curve_count"),
            F.count_if(is_scalar()).alias("scalar_curve_count"),
            F.count_if(is_displayable("preview_count")).alias("displayable_count"),
            F.coalesce(F.sum("preview_count"), F.lit(0)).alias("preview_count"),
        )
    )
    numbers = ["curve_count", "scalar_curve_count", "displayable_count", "preview_count"]
    reference = time_reference(metadata_map("native_metadata")["time_index_reference"])
    return (
        datasets.withColumn("time_index_reference", reference)
        .join(counts, DATASET_KEYS, "left")
        .fillna(0, numbers)
        .join(effective_settings(datasets, settings), DATASET_KEYS, "left")
        .drop("native_metadata")
    )


def document_overview(
    sources: DataFrame, overview: DataFrame, objects: DataFrame, warnings: DataFrame
) -> DataFrame:
    """One row per document: source facts and totals."""
    of_datasets = overview.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.sum("scalar_curve_count").alias("scalar_curve_count"),
    )
    of_objects = objects.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("preserved_object_count")
    )
    of_warnings = warnings.groupBy("document_id").agg(F.count(F.lit(1)).alias("warning_count"))
    totals = ["dataset_count", "scalar_curve_count", "preserved_object_count", "warning_count"]
    return (
        sources.join(of_datasets, "document_id", "left")
        .join(of_objects, "document_id", "left")
        .join(of_warnings, "document_id", "left")
        .fillna(0, totals)
    )


def document_trees(
    datasets: DataFrame,
    channels: DataFrame,
    previews: DataFrame,
    settings: DataFrame,
    document_ids: Sequence[str],
) -> DataFrame:
    """Datasets of the named documents with their curves nested by position.

    For the few documents a caller opens; bulk questions use ``dataset_overview``.
    """
    wanted = F.col("document_id").isin(*document_ids)
    points = (
        previews.where(wanted)
        .groupBy(*DATASET_KEYS, "channel_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "index_value", "value"))).alias(
                "preview_samples"
            )
        )
    )
    curve = F.struct(
        "position", "channel_id", "mnemonic", "unit", "description", "minimum", "maximum",
        "sample_count", "null_count", "sample_shape", "storage_kind", "preview_samples",
    )
    curves = (
        channels.where(wanted)
        .join(points, [*DATASET_KEYS, "channel_id"], "left")
        .groupBy(*DATASET_KEYS)
        .agg(F.array_sort(F.collect_list(curve)).alias("curves"))
    )
    overview = dataset_overview(
        datasets.where(wanted), channels.where(wanted), previews.where(wanted), settings.where(wanted)
    )
    return overview.join(curves, DATASET_KEYS, "left").orderBy("document_id", "position")


def default_datasets(overview: DataFrame) -> DataFrame:
    """Per document the first dataset with scalar curves, and the first that can be drawn."""
    scalar = F.when(F.col("scalar_curve_count") > 0, F.col("position"))
    drawable = F.when(
        (F.col("index_maximum") > F.col("index_minimum")) & (F.col("displayable_count") > 0),
        F.col("position"),
    )
    return overview.groupBy("document_id").agg(
        F.min_by("dataset_id", scalar).alias("first_scalar_dataset"),
        F.min_by("dataset_id", drawable).alias("first_displayable_dataset"),
    )


def frame_edges(channels: DataFrame) -> DataFrame:
    """``contains`` edges from a frame object to the fingerprints of its channels."""
    metadata = metadata_map("native_metadata")
    return channels.select(
        "document_id",
        F.col("frame_object_id").alias("source_object_id"),
        F.coalesce(F.nullif(metadata["fingerprint"], F.lit("")), "mnemonic").alias(
            "target_native_id"
        ),
        F.lit("contains").alias("relationship_type"),
    )


def version_labels(versions: DataFrame, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """Distinct versions of a document, sorted and joined by a comma."""
    return versions.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("source_version")
    )


def first_names(named: DataFrame, fallback: Column, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """First non-empty ``name`` by ``position``."""
    place = F.when(F.coalesce(F.trim("name"), F.lit("")) != "", F.col("position"))
    return named.groupBy(*keys).agg(F.min_by("name", place).alias("first_name")).withColumn(
        "first_name", F.coalesce("first_name", fallback)
    )
