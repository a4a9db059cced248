"""Queries that write and read back, and the raw columns and orders behind them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curveframe.operators import index_selection, lod, pages, stats
from curveframe.plans import ingest
from curveframe.plans import tables as t
from curveframe.plans.ranges import lod_visible_range
from curveframe.plans.registry import ORACLES, query
from curveframe.schema import DATASET_KEYS
from curveframe.session import checkpoint_directory
from curveframe.sources import frames, las, sinks

WANTED = ["tax", "quantity"]


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read what the others write."""
    return f"{checkpoint_directory(spark)}/{name}-{uuid4().hex}"


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    path = _folder(spark, "samples")
    sinks.write_samples(stats.unpivot_channels(t.lines_wide(spark, folder), t.LINE_CHANNELS), path)
    return sinks.read_samples(spark, path)


@query("WITH " + t.LINES_LONG + "\nSELECT * FROM long")
def stored_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder)


@query(
    "WITH " + t.LINES_LONG + """
SELECT * FROM long WHERE dataset_id = 'supplier-1' AND channel_id IN ('tax', 'quantity')"""
)
def scanned_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen curves of one dataset; the filter reaches the row groups of the sorted files."""
    return sinks.scan_channels(_stored(spark, folder), "lineitem", "supplier-1", WANTED)


@query(
    """SELECT 'arrays' AS document_id, 'label-' || "label" AS dataset_id, 'image' AS channel_id, vec_id AS ordinal,
  list_transform(embedding, lambda x: x::DOUBLE) AS "values", [len(embedding)::INT] AS shape FROM embeddings"""
)
def stored_arrays(spark: SparkSession, folder: str) -> DataFrame:
    arrays = t.table(spark, folder, "embeddings").select(
        F.lit("arrays").alias("document_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("dataset_id"),
        F.lit("image").alias("channel_id"),
        F.col("vec_id").alias("ordinal"),
        F.transform("embedding", lambda item: item.cast("double")).alias("values"),
        F.array(F.size("embedding")).alias("shape"),
    )
    path = _folder(spark, "arrays")
    sinks.write_array_samples(arrays, path)
    return sinks.read_samples(spark, path)


@query(
    """SELECT 'nation-' || s_nationkey AS document_id, 'supplier-' || s_suppkey AS dataset_id,
  s_suppkey::INT AS position, s_name AS name, s_acctbal AS index_maximum, '1.0' AS package_version FROM supplier"""
)
def stored_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets of a catalog that was written twice: readers get the version published last."""
    suppliers = t.table(spark, folder, "supplier").select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("document_id"),
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("dataset_id"),
        F.col("s_suppkey").cast("int").alias("position"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("index_maximum"),
        *[F.lit(None).cast("string").alias(name) for name in ("kind", "well_name", "wellbore_name")],
        *[F.lit(None).cast("string").alias(name) for name in ("index_mnemonic", "index_unit", "index_kind")],
        F.lit(None).cast("bigint").alias("row_count"),
        F.lit(None).cast("double").alias("index_minimum"),
        F.lit(None).cast("string").alias("native_metadata"),
    )
    path = _folder(spark, "catalog")
    sinks.write_catalog({"datasets": suppliers.where("position % 2 = 0")}, path)
    sinks.write_catalog({"datasets": suppliers}, path)
    published = spark.read.parquet(f"{path}/published").select("package_version").distinct()
    stored = sinks.read_catalog(spark, path)["datasets"]
    version = published.first().package_version
    return stored.select("document_id", "dataset_id", "position", "name", "index_maximum", F.lit(version).alias("package_version"))


_CSV = "index double, quantity double, extendedprice double, discount double, tax double"


@query(
    "WITH " + t.LINES + """
SELECT "index", quantity, extendedprice, discount, tax FROM li WHERE dataset_id = 'supplier-1'"""
)
def exported_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of one dataset as CSV text, read again."""
    wide = t.lines_wide(spark, folder)
    samples = stats.unpivot_channels(wide, t.LINE_CHANNELS)
    path = _folder(spark, "csv")
    channels = t.lines_channels(spark, folder)
    header = pages.export_csv(wide, samples, channels, "lineitem", "supplier-1", "DAY", path, t.LINE_CHANNELS)
    lines = spark.read.option("lineSep", "\r\n").text(path).where(F.col("value") != ",".join(header))
    return lines.select(F.from_csv("value", _CSV, {"positiveInf": "Infinity"}).alias("row")).select("row.*")


@query(
    """SELECT 'orders' AS document_id, 'customer-' || o_custkey AS dataset_id, 0 AS position, 1 AS date_position,
  o_orderkey AS ordinal, epoch(date_trunc('second', o_orderdate::TIMESTAMP))::DOUBLE AS "index" FROM orders"""
)
def date_time_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """TIME cells of each row joined with the row's DATE cell."""
    orders = t.table(spark, folder, "orders").select(
        F.lit("orders").alias("document_id"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.array(F.date_format("o_orderdate", "HH:mm:ss"), F.date_format("o_orderdate", "dd-MMM-yy")).alias("cells"),
    )
    cells = orders.select(*DATASET_KEYS, "ordinal", F.posexplode("cells").alias("position", "raw"))
    curves = cells.select(*DATASET_KEYS, "position").distinct().select(
        *DATASET_KEYS,
        "position",
        F.when(F.col("position") == 0, "TIME").otherwise("DATE").alias("mnemonic"),
        F.lit(False).alias("is_numeric"),
    )
    return index_selection.pair_dates(cells, curves).drop("time_text", "date_text")


@query(
    "SELECT document_id, dataset_id, channel_id, ordinal, row_number() OVER (PARTITION BY document_id, dataset_id "
    "ORDER BY CASE channel_id WHEN 'tax' THEN 1 WHEN 'quantity' THEN 2 END NULLS FIRST, channel_id, ordinal) AS place FROM ("
    + ORACLES["lod_visible_range"] + ") WHERE channel_id IN ('tax', 'quantity')"
)
def lod_plot_order(spark: SparkSession, folder: str) -> DataFrame:
    """Reduced samples numbered in the order in which they are plotted: requested curves first to last."""
    view = lod_visible_range(spark, folder).where(F.col("channel_id").isin(*WANTED))
    plotted = lod.ordered_for_plot(view, WANTED).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy(*DATASET_KEYS).orderBy("at"))
    return plotted.select(*DATASET_KEYS, "channel_id", "ordinal", place.alias("place"))


@query(
    "WITH " + ingest._VALUES + f"""
SELECT document_id, {ingest._LAS_DATASET}, i - 1 AS ordinal, CASE WHEN vec_id % 3 = 2 THEN (i - 1)::VARCHAR END AS source_text,
  (i - 1) * CASE WHEN vec_id % 3 = 2 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS "index" FROM vals"""
)
def raw_index_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Time indexes as written in the file beside the canonical ones."""
    axis = las.ingest_las(ingest.las_documents(spark, folder), take_first=True).axis
    return axis.select(*DATASET_KEYS, "ordinal", F.col("index_source")["value"].alias("source_text"), "index")


@query(
    """WITH framed AS (
  SELECT 'frame-' || user_id % 10 AS dataset_id, event_id AS ordinal,
    CASE WHEN user_id % 10 < 3 AND event_id % 5 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL
      ELSE round(value, 2)::VARCHAR END AS stamp
  FROM events)
SELECT 'frames' AS document_id, dataset_id, ordinal,
  CASE WHEN max(stamp = 'n/a') OVER (PARTITION BY dataset_id) THEN ordinal::DOUBLE ELSE stamp::DOUBLE END AS "index"
FROM framed""".replace("stamp::DOUBLE", "try_cast(stamp AS DOUBLE)")
)
def frame_index_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Text indexes of frames: numbers where all are, row ordinals where one is not."""
    key = F.col("user_id") % 10
    frame = t.table(spark, folder, "events").select(
        F.lit("frames").alias("document_id"),
        F.concat(F.lit("frame-"), key.cast("string")).alias("dataset_id"),
        F.col("event_id").alias("ordinal"),
        F.when((key < 3) & (F.col("event_id") % 5 == 0), F.lit("n/a"))
        .when(F.col("event_id") % 11 == 0, F.lit(None))
        .otherwise(F.round("value", 2).cast("string"))
        .alias("stamp"),
    )
    return frames.frame_axis(frame, "stamp")
