"""Queries on data that takes the rarer branches of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.functions import timeindex
from curveframe.operators import assets, catalog, qc
from curveframe.operators.pages import select_channels
from curveframe.plans import catalogs as c
from curveframe.plans import tables as t
from curveframe.plans.quality import INDEX_RULES, profile_sql
from curveframe.plans.registry import query
from curveframe.schema import DATASET_KEYS, MAX_DETAIL_BYTES

_FALLING = """
fa AS (
  SELECT 'events' AS document_id, 'user-' || user_id AS dataset_id, event_id AS ordinal,
    CASE WHEN user_id % 3 = 0 THEN -event_id::DOUBLE WHEN event_id % 40 = 0 THEN NULL ELSE event_id::DOUBLE END AS "index"
  FROM events)"""


@query("WITH " + profile_sql(_FALLING, "fa") + "\n" + INDEX_RULES)
def qc_falling_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Index rules where a third of the datasets is stored from bottom to top."""
    key = F.col("event_id").cast("double")
    axis = t.table(spark, folder, "events").select(
        F.lit("events").alias("document_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("event_id").alias("ordinal"),
        F.when(F.col("user_id") % 3 == 0, -key).when(~t.every("event_id", 40), key).alias("index"),
    )
    return qc.index_issues(qc.index_profile(axis)).drop("evidence")


ASKED = ["part-7", "part-2", "part-11", "part-5", "part-1", "part-23", "part-90"]


@query(
    "WITH " + c._CHANNELS + f"""
SELECT document_id, dataset_id, channel_id, list_position({ASKED}, channel_id) - 1 AS request_position
FROM pc WHERE {c._READABLE} AND channel_id IN {tuple(ASKED)}"""
)
def requested_page_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of a page in the order in which they were asked for."""
    chosen = select_channels(c._channels(spark, folder), ASKED)
    return chosen.select(*DATASET_KEYS, "channel_id", "request_position")


_LABELS = """
SELECT event_id, CASE
  WHEN mode = 'clock' AND clock IS NOT NULL
    THEN strftime(make_timestamp((clock * 1e6)::BIGINT) + INTERVAL 330 MINUTE, '%d %b %H:%M:%S')
  ELSE CASE WHEN s < 0 THEN '−' ELSE '' END || CASE WHEN r >= 86400 THEN (r // 86400)::VARCHAR || 'd ' ELSE '' END ||
    lpad(((r % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((r % 3600) // 60)::VARCHAR, 2, '0') || ':' ||
    lpad((r % 60)::VARCHAR, 2, '0') END AS label
FROM (SELECT event_id, mode, s, abs(floor(s + 0.5::DOUBLE))::BIGINT AS r,
    CASE WHEN event_id % 7 = 0 THEN 1600000000.0::DOUBLE + (i - 1704000000.0::DOUBLE)
      WHEN event_id % 3 = 0 THEN i END AS clock
  FROM (SELECT event_id, i, i - 1704100000.0::DOUBLE AS s, CASE WHEN event_id % 2 = 0 THEN 'clock' ELSE 'elapsed' END AS mode
    FROM (SELECT event_id, floor(epoch_us(ts) / 1e6) AS i FROM events)))"""


@query(_LABELS)
def index_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by display mode, anchor, reference and a zone that is half an hour off."""
    key = F.col("event_id")
    anchored = key % 7 == 0
    label = timeindex.index_label(
        F.floor(timeindex.epoch_seconds("ts")).cast("double"),
        F.lit(1704100000.0),
        F.when(key % 2 == 0, "clock").otherwise("elapsed"),
        F.when(key % 3 == 0, "absolute_utc").otherwise("elapsed"),
        F.when(anchored, F.lit(1704000000.0)),
        F.when(anchored, F.lit(1600000000.0)),
        zone="Asia/Kolkata",
    )
    return t.table(spark, folder, "events").select("event_id", label.alias("label"))


_CUT = f"""
WITH given AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN repeat(md5("text"), 8191 + doc_id % 3)
      WHEN 1 THEN '{{"id":' || doc_id || ',"tags":["a","b"]}}' WHEN 2 THEN '{{broken' ELSE "text" END AS payload,
    'documents/' || doc_id || CASE WHEN doc_id % 8 < 5 THEN '.json' ELSE '.xml' END AS p
  FROM documents),
sized AS (
  SELECT *, strlen(payload)::BIGINT AS size_bytes, strlen(payload) > {MAX_DETAIL_BYTES} AS truncated,
    p LIKE '%.json' AND strlen(payload) <= {MAX_DETAIL_BYTES} AND payload LIKE '{{"id"%' AS is_json FROM given)
SELECT 'object-' || doc_id AS id, p AS metadata_path,
  CASE WHEN is_json THEN 'application/json' WHEN p LIKE '%.xml' THEN 'application/xml' ELSE 'text/plain' END AS content_type,
  CASE WHEN is_json THEN payload END AS content_json,
  CASE WHEN NOT is_json THEN CASE WHEN truncated THEN left(payload, {MAX_DETAIL_BYTES}) ELSE payload END END AS "text",
  size_bytes, truncated FROM sized"""


@query(_CUT)
def object_details_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Object payloads around the size limit, valid and broken JSON, and plain texts."""
    key = F.col("doc_id")
    payload = (
        F.when(key % 4 == 0, F.expr("repeat(md5(text), cast(8191 + doc_id % 3 as int))"))
        .when(key % 4 == 1, F.format_string('{"id":%d,"tags":["a","b"]}', key))
        .when(key % 4 == 2, "{broken")
        .otherwise(F.col("text"))
    )
    objects = t.table(spark, folder, "documents").select(
        F.concat(F.lit("object-"), key.cast("string")).alias("id"),
        *[F.lit(None).cast("string").alias(name) for name in ("object_type", "native_id", "name", "parent_native_id")],
        F.concat(F.lit("documents/"), key.cast("string"), F.when(key % 8 < 5, ".json").otherwise(".xml")).alias("metadata_path"),
        payload.alias("payload"),
    )
    return catalog.object_details(objects).select(
        "id", "metadata_path", "content_type", "content_json", "text", "size_bytes", "truncated"
    )


@query(
    c._ERRORS.rstrip() + """,
versions AS (SELECT DISTINCT lang AS document_id, CASE WHEN lang IN ('en', 'de') THEN '1.0' ELSE '0.' || lang END AS v FROM documents)
SELECT * FROM errors UNION ALL
SELECT document_id, NULL, 'package version ' || v || ' is not supported' FROM versions WHERE v <> '1.0'"""
)
def package_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Asset errors of all packages, and packages of versions that cannot be read."""
    files = c._files(spark, folder)
    language = F.col("document_id")
    packages = files.select("document_id").distinct().withColumn(
        "package_version", F.when(language.isin("en", "de"), "1.0").otherwise(F.concat(F.lit("0."), language))
    )
    return assets.verify_assets(c._manifest(files), c._actual(files), packages)


_SETTINGS = """
given AS (
  SELECT 'events' AS document_id, 'user-' || user_id AS dataset_id, user_id, event_id % 2 = 0 AS stored,
    CASE WHEN event_type = 'click' THEN 'clock' ELSE 'elapsed' END AS time_display_mode,
    CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'utc' END AS time_zone,
    CASE WHEN event_id % 5 > 0 THEN floor(value) END AS manual_anchor_index, event_id // 1000 AS version FROM events)"""


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "events").select(
        F.lit("events").alias("document_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.when(F.col("event_type") == "click", "clock").otherwise("elapsed").alias("time_display_mode"),
        F.when(t.every("event_id", 3), "local").otherwise("utc").alias("time_zone"),
        F.when(~t.every("event_id", 5), F.floor("value").cast("double")).alias("manual_anchor_index"),
        F.expr("event_id div 1000").alias("version"),
        "user_id",
        t.every("event_id", 2).alias("stored"),
    )


def _known_users(settings: DataFrame) -> DataFrame:
    return settings.where(F.col("user_id") % 6 > 0).select(*DATASET_KEYS).distinct()


@query(
    "WITH " + _SETTINGS + """
SELECT document_id, dataset_id, time_display_mode, time_zone, manual_anchor_index, version FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, dataset_id ORDER BY version DESC, time_display_mode DESC,
    time_zone DESC, manual_anchor_index DESC NULLS LAST) AS place FROM given WHERE stored OR user_id % 6 > 0)
WHERE place = 1"""
)
def view_settings_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Stored settings and a batch of updates: several of one dataset, some at one version, some of no dataset."""
    given = _settings(spark, folder)
    datasets = _known_users(given)
    rows = given.drop("user_id", "stored")
    return catalog.upsert_settings(
        rows.where(given["stored"]), rows.where(~given["stored"]), datasets
    )


@query(
    "WITH " + _SETTINGS + """
SELECT DISTINCT document_id, dataset_id, 'Dataset ' || dataset_id || ' was not found.' AS message
FROM given WHERE NOT stored AND user_id % 6 = 0"""
)
def view_settings_unknown(spark: SparkSession, folder: str) -> DataFrame:
    given = _settings(spark, folder)
    return catalog.unknown_setting_targets(given.where(~F.col("stored")), _known_users(given))


OPENED = ["nation-3", "nation-7", "nation-11"]
_TREE = "WITH " + c._CHANNELS + "," + c._CATALOG + f""",
pv AS (
  SELECT 'supplier-' || l_suppkey AS dataset_id, 'part-' || l_partkey AS channel_id, l_orderkey * 8 + l_linenumber AS ordinal,
    l_quantity AS v FROM lineitem),
points AS (
  SELECT dataset_id, channel_id, count(*) AS n, list(v ORDER BY ordinal, v)[1] AS first_value FROM pv GROUP BY ALL),
placed AS (
  SELECT points.*, position, mnemonic, storage_kind, row_number() OVER (PARTITION BY points.dataset_id ORDER BY position) - 1 AS place
  FROM points JOIN (SELECT channel_id, position, mnemonic, storage_kind FROM pc) USING (channel_id))
SELECT o.document_id, o.dataset_id, o.position, o.name, o.time_display_mode, o.curve_count, o.scalar_curve_count,
  place, channel_id, mnemonic, storage_kind, n AS preview_samples, first_value
FROM overview o LEFT JOIN placed USING (dataset_id) WHERE o.document_id IN {tuple(OPENED)}"""


@query(_TREE)
def document_curves(spark: SparkSession, folder: str) -> DataFrame:
    """The nested answer for three opened documents, its curves and their preview samples laid out in order."""
    tables = c._catalog(spark, folder)
    none = F.lit(None)
    channels = tables["channels"].select(
        "*",
        none.cast("string").alias("unit"),
        none.cast("string").alias("description"),
        none.cast("bigint").alias("sample_count"),
        none.cast("bigint").alias("null_count"),
    )
    previews = t.table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("channel_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        F.col("l_quantity").alias("index_value"),
        F.col("l_quantity").alias("value"),
    ).join(tables["datasets"].select(*DATASET_KEYS), "dataset_id")
    trees = catalog.document_trees(tables["datasets"], channels, previews, tables["settings"], OPENED)
    return trees.select(
        *DATASET_KEYS, "position", "name", "time_display_mode", "curve_count", "scalar_curve_count",
        F.posexplode_outer("curves").alias("place", "curve"),
    ).select(
        *DATASET_KEYS, "position", "name", "time_display_mode", "curve_count", "scalar_curve_count", "place",
        "curve.channel_id", "curve.mnemonic", "curve.storage_kind",
        F.size("curve.preview_samples").cast("bigint").alias("preview_samples"),
        F.get("curve.preview_samples", F.lit(0))["value"].alias("first_value"),
    )


@query(
    "WITH " + t.OBJECTS + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY object_type, name, id) AS place,
    count(*) OVER (PARTITION BY document_id) AS total FROM ob)
SELECT document_id, place, total, id, object_type, native_id, name, parent_native_id
FROM placed WHERE place <= 1050"""
)
def deep_object_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page too long for a top-k: by the offsets of sorted ranges."""
    return catalog.object_pages_by_document(t.document_objects(spark, folder), 0, 1050)
