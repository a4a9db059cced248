"""Queries over single column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.functions import numeric, text, timeindex
from curveframe.plans import tables as t
from curveframe.plans.registry import query

# Units as they come in files: known spellings, odd letter case, unknown ones.
UNITS = ["S", " sec ", "ms", "Milliseconds", "MIN", "h", "Hours", "day", "fortnight", ""]
FACTORS = [1.0, 1.0, 0.001, 0.001, 60.0, 3600.0, 3600.0, 86400.0, 1.0, 1.0]


def _unit():
    return F.element_at(
        F.array(*[F.lit(unit) for unit in UNITS]), (F.col("event_id") % 10 + 1).cast("int")
    )


@query(
    f"""SELECT event_id, ({UNITS})[event_id % 10 + 1] AS unit, ({FACTORS})[event_id % 10 + 1]::DOUBLE AS factor,
  value * ({FACTORS})[event_id % 10 + 1]::DOUBLE AS seconds, event_id % 10 >= 8 AS assumed FROM events"""
)
def time_unit_factor(spark: SparkSession, folder: str) -> DataFrame:
    factor = timeindex.time_unit_factor(_unit())
    return t.table(spark, folder, "events").select(
        "event_id",
        _unit().alias("unit"),
        factor.alias("factor"),
        (F.col("value") * factor).alias("seconds"),
        timeindex.known_unit_factor(_unit()).isNull().alias("assumed"),
    )


@query(
    """SELECT event_id, CASE WHEN s < 0 THEN '−' ELSE '' END ||
  CASE WHEN r >= 86400 THEN (r // 86400)::VARCHAR || 'd ' ELSE '' END ||
  lpad(((r % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((r % 3600) // 60)::VARCHAR, 2, '0') || ':' ||
  lpad((r % 60)::VARCHAR, 2, '0') AS label
FROM (SELECT event_id, s, abs(floor(s + 0.5::DOUBLE))::BIGINT AS r
  FROM (SELECT event_id, (event_id - 3000) * 97.25::DOUBLE + value AS s FROM events))"""
)
def elapsed_label(spark: SparkSession, folder: str) -> DataFrame:
    seconds = (F.col("event_id") - 3000) * F.lit(97.25) + F.col("value")
    return t.table(spark, folder, "events").select(
        "event_id", timeindex.elapsed_label(seconds).alias("label")
    )


@query(
    """SELECT event_id, clock, strftime(make_timestamp((clock * 1e6)::BIGINT), '%d %b %H:%M:%S') AS label
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1700000000.0::DOUBLE + (i - 1704000000.0::DOUBLE) ELSE i END
  AS clock FROM (SELECT event_id, floor(epoch_us(ts) / 1e6) AS i FROM events))"""
)
def index_to_clock(spark: SparkSession, folder: str) -> DataFrame:
    anchored = t.every("event_id", 3)
    clock = timeindex.clock_seconds(
        F.floor(timeindex.epoch_seconds("ts")).cast("double"),
        F.lit("absolute_utc"),
        F.when(anchored, F.lit(1704000000.0)),
        F.when(anchored, F.lit(1700000000.0)),
    )
    return t.table(spark, folder, "events").select(
        "event_id", clock.alias("clock"), timeindex.clock_label(clock).alias("label")
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL
  ELSE floor(epoch_us(ts) / 1e6) + CASE WHEN event_id % 4 = 1 THEN 0.25::DOUBLE ELSE 0.0 END END AS epoch
FROM events"""
)
def date_time_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """Date and time texts in four spellings, some of them unreadable."""
    moment = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    date = (
        F.when(t.every("event_id", 19), "31-Foo-24")
        .when(kind == 0, F.date_format(moment, "dd-MMM-yy"))
        .when(kind == 1, F.upper(F.date_format(moment, "d-MMM-yyyy")))
        .when(kind == 2, F.date_format(moment, "yyyy-MM-dd"))
        .otherwise(F.date_format(moment, "d-MMM-yyyy"))
    )
    clock = F.concat(
        F.date_format(moment, "HH:mm:ss"), F.when(kind == 1, ".25").otherwise("")
    )
    return t.table(spark, folder, "events").select(
        "event_id", timeindex.date_time_epoch(date, clock).alias("epoch")
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE
  floor(epoch_us(ts) / 1e6) - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END END AS epoch FROM events"""
)
def iso_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """ISO texts with Z, with an offset and without a zone, some of them unreadable."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 3
    spelled = F.concat(stamp, F.when(kind == 0, "Z").when(kind == 1, "+02:00").otherwise(""))
    texts = F.when(t.every("event_id", 23), "12.5").otherwise(spelled)
    return t.table(spark, folder, "events").select(
        "event_id", timeindex.iso_epoch(texts).alias("epoch")
    )


@query(
    """SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower("text"), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')
  AS slug FROM documents"""
)
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "documents").select("doc_id", text.slug("text").alias("slug"))


@query(
    """SELECT 'curve-' || p_partkey || '-' || coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+',
  '-', 'g'), '-'), ''), 'item') AS channel_id, CASE WHEN p_size % 4 = 0 THEN 'Imported LAS curve' ELSE p_type END
  AS description, trim(p_brand) || ' ' || p_size AS squished FROM part"""
)
def channel_names(spark: SparkSession, folder: str) -> DataFrame:
    described = F.when(F.col("p_size") % 4 == 0, " \t ").otherwise(F.col("p_type"))
    padded = F.concat(F.lit("  "), "p_brand", F.lit(" \t\n "), F.col("p_size").cast("string"), F.lit(" "))
    return t.table(spark, folder, "part").select(
        text.channel_id("p_partkey", "p_name").alias("channel_id"),
        text.first_text(described, F.lit("Imported LAS curve")).alias("description"),
        text.squish(padded).alias("squished"),
    )


@query(
    """SELECT p_partkey, CASE WHEN m IN ('dept', 'depth', 'md', 'mdepth') THEN 'measured_depth'
  WHEN m IN ('tvd', 'tvdss', 'tvdepth') THEN 'true_vertical_depth'
  WHEN m IN ('time', 'etime', 'elapsed', 'seconds', 'sec') THEN 'time' ELSE 'other' END AS kind,
  CASE WHEN p_size % 2 = 0 OR m IN ('dept', 'depth', 'md') THEN 'measured_depth'
    WHEN p_size % 3 = 0 THEN 'time' ELSE 'sample' END AS frame_kind,
  CASE WHEN p_size % 2 > 0 AND p_size % 3 = 0 THEN 'time' ELSE 'measured_depth' END AS log_kind
FROM (SELECT *, (['dept', 'md', 'tvdss', 'etime', 'sec', 'gr'])[p_partkey % 6 + 1] AS m FROM part)"""
)
def index_kinds(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(name) for name in ("DEPT", "md", "TVDSS", "ETime", "Sec", "GR")])
    name = F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int"))
    stated = F.when(F.col("p_size") % 2 == 0, "BOREHOLE-DEPTH").when(F.col("p_size") % 3 == 0, "Time")
    return t.table(spark, folder, "part").select(
        "p_partkey",
        timeindex.index_kind(name).alias("kind"),
        timeindex.frame_index_kind(stated, name).alias("frame_kind"),
        timeindex.log_index_kind(stated).alias("log_kind"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 4) THEN NULL ELSE value END AS number FROM events"""
)
def finite_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of numbers, infinities, NaN and words read as finite numbers or null."""
    kind = F.col("event_id") % 6
    texts = (
        F.when(kind == 0, F.when(t.every("event_id", 12), "inf").otherwise("NaN"))
        .when(kind == 4, F.col("event_type"))
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    )
    return t.table(spark, folder, "events").select(
        "event_id", numeric.finite_number(texts).alias("number")
    )


@query(
    """SELECT l_suppkey, printf('%.1f', round_even(n / m * 100, 1)) || '%' AS percent,
  round_even(n / m, 6) AS ratio
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) AS m FROM lineitem GROUP BY ALL)"""
)
def ratio_texts(spark: SparkSession, folder: str) -> DataFrame:
    counted = t.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count(F.lit(1)).alias("m")
    )
    share = numeric.ratio("n", "m")
    return counted.select(
        "l_suppkey",
        numeric.percent_text(share).alias("percent"),
        numeric.rounded_ratio(share).alias("ratio"),
    )
