"""The driver tables seen as curve datasets.

The tables hold no nulls, NaN, duplicates or reversals in the columns that serve
as index and curves, so faults are put in by value: all rows stay, and the SQL
fragments below do the same to the oracle's input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.functions.timeindex import epoch_seconds
from curveframe.session import prepare
from curveframe.sources.registry import row_ordinals

NAN = float("nan")
INF = float("inf")
LINE_CHANNELS = ["quantity", "extendedprice", "discount", "tax"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def every(column: str, step: int) -> Column:
    return F.col(column) % step == 0


def events_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user: epoch-second index with null, infinite, repeated and reversed values."""
    events = table(spark, folder, "events")
    base = epoch_seconds("ts")
    index = (
        F.when(every("event_id", 97), F.lit(None))
        .when(every("event_id", 89), F.lit(INF))
        .when(every("event_id", 53), base - 86400)
        .when(every("event_id", 7), F.floor(base / 86400).cast("double") * 86400)
        .otherwise(base)
    )
    return events.select(
        F.lit("events").alias("document_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("event_id").alias("ordinal"),
        index.alias("index"),
        _faulty_value().alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _faulty_value() -> Column:
    return (
        F.when(every("event_id", 11), F.lit(None))
        .when(every("event_id", 13), F.lit(INF))
        .when(every("event_id", 17), F.lit(NAN))
        .otherwise(F.col("value"))
    )


EVENTS = """
ev AS (
  SELECT 'events' AS document_id, 'user-' || user_id AS dataset_id, event_id AS ordinal,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE
         WHEN event_id % 53 = 0 THEN epoch_us(ts) / 1e6 - 86400
         WHEN event_id % 7 = 0 THEN floor(epoch_us(ts) / 1e6 / 86400) * 86400
         ELSE epoch_us(ts) / 1e6 END AS "index",
    CASE WHEN event_id % 11 = 0 THEN NULL
         WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE
         WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE
         ELSE value END AS value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
)"""


def lines_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per supplier in file order: day index, four curves, some of them faulty."""
    items = row_ordinals(table(spark, folder, "lineitem"))
    return items.select(
        F.lit("lineitem").alias("document_id"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        "ordinal",
        F.floor(epoch_seconds("l_shipdate") / 86400).cast("double").alias("index"),
        F.col("l_quantity").alias("quantity"),
        F.when(every("l_orderkey", 10), F.lit(INF))
        .otherwise(F.col("l_extendedprice"))
        .alias("extendedprice"),
        F.when(F.col("l_orderkey") % 10 < 3, F.lit(None))
        .otherwise(F.col("l_discount"))
        .alias("discount"),
        F.when(every("l_suppkey", 5), F.lit(0.5)).otherwise(F.col("l_tax")).alias("tax"),
    )


LINES = """
li AS (
  SELECT 'lineitem' AS document_id, 'supplier-' || l_suppkey AS dataset_id,
    row_number() OVER () - 1 AS ordinal,
    floor(epoch_us(l_shipdate::TIMESTAMP) / 1e6 / 86400)::DOUBLE AS "index",
    l_quantity AS quantity,
    CASE WHEN l_orderkey % 10 = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS extendedprice,
    CASE WHEN l_orderkey % 10 < 3 THEN NULL ELSE l_discount END AS discount,
    CASE WHEN l_suppkey % 5 = 0 THEN 0.5 ELSE l_tax END AS tax
  FROM lineitem
)"""
LINES_LONG = (
    LINES
    + """,
long AS (
  SELECT document_id, dataset_id, ordinal, "index", 'quantity' AS channel_id, quantity AS value FROM li
  UNION ALL SELECT document_id, dataset_id, ordinal, "index", 'extendedprice', extendedprice FROM li
  UNION ALL SELECT document_id, dataset_id, ordinal, "index", 'discount', discount FROM li
  UNION ALL SELECT document_id, dataset_id, ordinal, "index", 'tax', tax FROM li
)"""
)


def lines_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Channel catalog of ``lines_wide``: a repeated mnemonic and a missing unit."""
    facts = F.array(
        *[
            F.struct(
                F.lit(channel).alias("channel_id"),
                F.lit(place).alias("position"),
                F.lit(mnemonic).alias("mnemonic"),
                F.lit(unit).alias("unit"),
            )
            for place, (channel, mnemonic, unit) in enumerate(LINE_CATALOG)
        ]
    )
    return (
        table(spark, folder, "supplier")
        .select(
            F.lit("lineitem").alias("document_id"),
            F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("dataset_id"),
            F.explode(facts).alias("channel"),
        )
        .select(
            "document_id",
            "dataset_id",
            "channel.*",
            F.col("channel.mnemonic").alias("description"),
            F.array().cast("array<int>").alias("sample_shape"),
            F.lit("parquet").alias("storage_kind"),
            F.lit("numeric").alias("data_type"),
        )
    )


LINE_CATALOG = [
    ("quantity", "QTY", "ea"),
    ("extendedprice", "PRICE", "usd"),
    ("discount", "RATE", " "),
    ("tax", "rate", "1"),
]
CHANNELS = """
ch AS (
  SELECT 'lineitem' AS document_id, 'supplier-' || s_suppkey AS dataset_id,
    c.channel_id, c.position, c.mnemonic, c.unit
  FROM supplier, (VALUES ('quantity', 0, 'QTY', 'ea'), ('extendedprice', 1, 'PRICE', 'usd'),
    ('discount', 2, 'RATE', ' '), ('tax', 3, 'rate', '1')) c(channel_id, position, mnemonic, unit)
)"""


def orders_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per customer: day index with ties and reversals, one curve."""
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("document_id"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.floor(epoch_seconds("o_orderdate") / 86400).cast("double").alias("index"),
        F.col("o_totalprice").alias("totalprice"),
    )


ORDERS = """
od AS (
  SELECT 'orders' AS document_id, 'customer-' || o_custkey AS dataset_id, o_orderkey AS ordinal,
    floor(epoch_us(o_orderdate::TIMESTAMP) / 1e6 / 86400)::DOUBLE AS "index",
    o_totalprice AS totalprice
  FROM orders
)"""


def part_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as channels of one dataset per type, with repeated mnemonics."""
    return table(spark, folder, "part").select(
        F.lit("part").alias("document_id"),
        F.lower("p_type").alias("dataset_id"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("channel_id"),
        F.col("p_partkey").alias("position"),
        F.when(every("p_partkey", 3), F.upper("p_name")).otherwise(F.col("p_name")).alias("mnemonic"),
        F.col("p_brand").alias("unit"),
        F.col("p_type").alias("description"),
    )


PARTS = """
pt AS (
  SELECT 'part' AS document_id, lower(p_type) AS dataset_id, 'part-' || p_partkey AS channel_id,
    p_partkey AS position,
    CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS mnemonic,
    p_brand AS unit, p_type AS description
  FROM part
)"""


def document_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as preserved objects: language is the type, the whole text the name."""
    return table(spark, folder, "documents").select(
        F.col("lang").alias("document_id"),
        F.format_string("object-%09d", F.col("doc_id")).alias("id"),
        F.col("lang").alias("object_type"),
        F.col("source").alias("native_id"),
        F.col("text").alias("name"),
        F.lit(None).cast("string").alias("parent_native_id"),
    )


OBJECTS = """
ob AS (
  SELECT lang AS document_id, 'object-' || lpad(doc_id::VARCHAR, 9, '0') AS id,
    lang AS object_type, source AS native_id, "text" AS name, NULL::VARCHAR AS parent_native_id
  FROM documents
)"""
