"""Range, level-of-detail, cursor and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.operators import cursor, lod, pages, stats
from curveframe.plans import tables as t
from curveframe.plans.registry import query
from curveframe.schema import DATASET_KEYS

# A viewport over the line items, given in reverse order on purpose.
RANGE_HIGH, RANGE_LOW = 10800.0, 9500.0

_PICKS = """, ranked AS (
  SELECT *, row_number() OVER (b ORDER BY ordinal) AS first_rank,
    row_number() OVER (b ORDER BY ordinal DESC) AS last_rank,
    row_number() OVER (s ORDER BY ordinal) AS state_rank,
    row_number() OVER (s ORDER BY value, ordinal) AS low_rank,
    row_number() OVER (s ORDER BY value DESC, ordinal) AS high_rank
  FROM bucketed
  WINDOW b AS (PARTITION BY document_id, dataset_id, channel_id, bucket),
    s AS (PARTITION BY document_id, dataset_id, channel_id, bucket, value IS NULL))
SELECT document_id, dataset_id, channel_id, bucket, ordinal, "index", value FROM ranked
WHERE first_rank = 1 OR last_rank = 1 OR (value IS NULL AND state_rank = 1)
  OR (value IS NOT NULL AND (low_rank = 1 OR high_rank = 1))"""
_BUCKET = (
    'CASE WHEN {high} - {low} > 0 THEN greatest(least(floor(("index" - {low}) / ({high} - {low}) * {n})::INT, '
    "{n} - 1), 0) ELSE 0 END"
)
_CLEAN = "CASE WHEN isfinite(value) THEN value END AS value"


@query(
    "WITH " + t.LINES_LONG + f""", bucketed AS (
  SELECT document_id, dataset_id, channel_id, ordinal, "index", {_CLEAN},
    {_BUCKET.format(low=RANGE_LOW, high=RANGE_HIGH, n=10)} AS bucket
  FROM long WHERE "index" BETWEEN {RANGE_LOW} AND {RANGE_HIGH})""" + _PICKS
)
def lod_visible_range(spark: SparkSession, folder: str) -> DataFrame:
    return lod.wide_visible_range(
        t.lines_wide(spark, folder), t.LINE_CHANNELS, RANGE_HIGH, RANGE_LOW, viewport_height=100
    )


@query(
    "WITH " + t.EVENTS + f""", extents AS (
  SELECT document_id, dataset_id, min("index") AS low, max("index") AS high
  FROM ev WHERE isfinite("index") GROUP BY ALL),
long AS (
  SELECT document_id, dataset_id, ordinal, "index", 'value' AS channel_id, value FROM ev
  UNION ALL SELECT document_id, dataset_id, ordinal, "index", 'k', k FROM ev),
bucketed AS (
  SELECT document_id, dataset_id, channel_id, ordinal, "index", {_CLEAN},
    {_BUCKET.format(low="low", high="high", n=40)} AS bucket
  FROM long JOIN extents USING (document_id, dataset_id) WHERE isfinite("index"))""" + _PICKS
)
def lod_full_extent(spark: SparkSession, folder: str) -> DataFrame:
    buckets = lod.buckets_per_curve(2, point_budget=400, viewport_height=500)
    bucketed = lod.with_extent_buckets(t.events_axis(spark, folder), buckets)
    return lod.bucket_samples(
        stats.unpivot_channels(bucketed, ["value", "k"], ("ordinal", "index", "bucket"))
    )


@query(
    "WITH " + t.LINES + f"""
SELECT * FROM li WHERE "index" BETWEEN {RANGE_LOW} AND {RANGE_HIGH}"""
)
def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return t.lines_wide(spark, folder).where(lod.in_range("index", RANGE_HIGH, RANGE_LOW))


def _cursors(axis: DataFrame) -> DataFrame:
    """Five cursors per dataset: inside, on a sample, and beyond both ends."""
    extent = stats.index_extent(axis).where(F.col("finite_count") > 0)
    low, high = F.col("index_minimum"), F.col("index_maximum")
    places = F.array(low + (high - low) * 0.37, low + (high - low) * 0.9, low, high + 5, low - 5)
    return extent.select(*DATASET_KEYS, F.explode(places).alias("query")).distinct()


_CURSOR = """, extents AS (
  SELECT document_id, dataset_id, min("index") AS low, max("index") AS high
  FROM {source} WHERE isfinite("index") GROUP BY ALL),
cursors AS (
  SELECT DISTINCT document_id, dataset_id, unnest([low + (high - low) * 0.37::DOUBLE,
    low + (high - low) * 0.9::DOUBLE, low, high + 5, low - 5]) AS query FROM extents),
near AS (
  SELECT c.query, s.*, row_number() OVER (PARTITION BY document_id, dataset_id, c.query
    ORDER BY abs(s."index" - c.query), s.ordinal) AS place
  FROM cursors c JOIN {source} s USING (document_id, dataset_id) WHERE s."index" IS NOT NULL)"""
_RESOLVED = """,
points AS (
  SELECT *, isfinite(value) AND value IS NOT NULL AS usable FROM long),
picked AS (
  SELECT document_id, dataset_id, query, channel_id,
    arg_min({'i': "index", 'v': value}, place) FILTER (WHERE usable
      AND abs("index" - query) <= greatest(1e-9, abs(query) * 1e-12)) AS exact,
    arg_min({'i': "index", 'v': value}, place) FILTER (WHERE usable) AS nearest,
    max({'i': "index", 'v': value}) FILTER (WHERE usable AND "index" < query) AS below,
    min({'i': "index", 'v': value}) FILTER (WHERE usable AND "index" > query) AS above
  FROM points GROUP BY ALL)
SELECT document_id, dataset_id, query, channel_id,
  CASE WHEN exact IS NOT NULL THEN exact.v
    WHEN below IS NOT NULL AND above IS NOT NULL THEN
      below.v + (query - below.i) / (above.i - below.i) * (above.v - below.v)
    ELSE nearest.v END AS value,
  CASE WHEN exact IS NOT NULL THEN exact.i
    WHEN below IS NOT NULL AND above IS NOT NULL THEN query ELSE nearest.i END AS sample_index,
  CASE WHEN exact IS NOT NULL THEN 'exact'
    WHEN below IS NOT NULL AND above IS NOT NULL THEN 'interpolated'
    WHEN nearest IS NOT NULL THEN 'nearest' ELSE 'no_data' END AS status
FROM picked"""


@query(
    "WITH " + t.EVENTS + _CURSOR.format(source="ev") + """, long AS (
  SELECT document_id, dataset_id, query, place, "index", 'value' AS channel_id, value FROM near WHERE place <= 32
  UNION ALL SELECT document_id, dataset_id, query, place, "index", 'k', k FROM near WHERE place <= 32)"""
    + _RESOLVED
)
def cursor_exact_interp(spark: SparkSession, folder: str) -> DataFrame:
    axis = t.events_axis(spark, folder)
    return cursor.cursor_values(axis, ["value", "k"], _cursors(axis))


@query(
    "WITH " + t.LINES + _CURSOR.format(source="li") + """, long AS (
  SELECT document_id, dataset_id, query, place, "index", 'discount' AS channel_id, discount AS value
  FROM near WHERE place <= 32)""" + _RESOLVED
)
def cursor_lines(spark: SparkSession, folder: str) -> DataFrame:
    wide = t.lines_wide(spark, folder)
    return cursor.cursor_values(wide, ["discount"], _cursors(wide))


@query(
    "WITH " + t.LINES + _CURSOR.format(source="li") + """, long AS (
  SELECT document_id, dataset_id, query, place, "index", 'rare' AS channel_id,
    CASE WHEN ordinal % 89 = 0 THEN quantity END AS value FROM near WHERE place <= 32)""" + _RESOLVED
)
def cursor_no_data(spark: SparkSession, folder: str) -> DataFrame:
    """A curve with long gaps: cursors far from its values have no data."""
    wide = t.lines_wide(spark, folder)
    rare = wide.withColumn("rare", F.when(F.col("ordinal") % 89 == 0, F.col("quantity")))
    return cursor.cursor_values(rare, ["rare"], _cursors(wide))


@query(
    "WITH " + t.ORDERS + _CURSOR.format(source="od") + """
SELECT document_id, dataset_id, query, place, ordinal, "index", totalprice FROM near WHERE place <= 32"""
)
def cursor_nearest_rows(spark: SparkSession, folder: str) -> DataFrame:
    axis = t.orders_axis(spark, folder)
    return cursor.nearest_rows(axis, _cursors(axis))


@query(
    "WITH " + t.LINES + """
SELECT * FROM li WHERE "index" IS NOT NULL ORDER BY abs("index" - 10000.25), ordinal LIMIT 32"""
)
def cursor_top_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cursor.nearest_rows_of_one(t.lines_wide(spark, folder), 10000.25)


@query(
    "WITH " + t.ORDERS + """, mid AS (
  SELECT document_id, dataset_id, (min("index") + max("index")) / 2 AS query FROM od GROUP BY ALL)
SELECT document_id, dataset_id, query, 'totalprice' AS channel_id, "index", value FROM (
  SELECT od.*, mid.query, totalprice AS value, row_number() OVER (
    PARTITION BY document_id, dataset_id ORDER BY abs("index" - query), ordinal) AS place
  FROM od JOIN mid USING (document_id, dataset_id) WHERE totalprice IS NOT NULL) WHERE place = 1"""
)
def cursor_nearest(spark: SparkSession, folder: str) -> DataFrame:
    axis = t.orders_axis(spark, folder)
    extent = stats.index_extent(axis)
    middle = (F.col("index_minimum") + F.col("index_maximum")) / 2
    return cursor.nearest_values(
        stats.unpivot_channels(axis, ["totalprice"]), extent.select(*DATASET_KEYS, middle.alias("query"))
    )


@query(
    "WITH " + t.LINES + """
SELECT * EXCLUDE (rn), rn AS position FROM (SELECT *, row_number() OVER (
  PARTITION BY document_id, dataset_id ORDER BY ordinal) - 1 AS rn FROM li) WHERE rn BETWEEN 50 AND 74"""
)
def row_page(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_rows(t.lines_wide(spark, folder), page=2, page_size=25)


@query(
    "WITH " + t.EVENTS + """
SELECT * EXCLUDE (rn), rn AS position FROM (SELECT document_id, dataset_id, ordinal, "index", k,
  row_number() OVER (PARTITION BY document_id, dataset_id ORDER BY ordinal) - 1 AS rn
  FROM ev WHERE "index" >= 1704500000 AND "index" <= 1705900000) WHERE rn BETWEEN 10 AND 19"""
)
def row_page_range(spark: SparkSession, folder: str) -> DataFrame:
    axis = t.events_axis(spark, folder).drop("value")
    return pages.page_rows(axis, 1, 10, index_minimum=1705900000.0, index_maximum=1704500000.0)


@query(
    "WITH " + t.PARTS + """
SELECT document_id, dataset_id, position, header,
  CASE WHEN n = 1 THEN header ELSE header || '_' || n END AS unique_header
FROM (SELECT document_id, dataset_id, position, mnemonic AS header, row_number() OVER (
  PARTITION BY document_id, dataset_id, mnemonic ORDER BY position) AS n FROM pt)"""
)
def unique_headers(spark: SparkSession, folder: str) -> DataFrame:
    headers = t.part_channels(spark, folder).select(
        *DATASET_KEYS, "position", F.col("mnemonic").alias("header")
    )
    return pages.unique_headers(headers)
