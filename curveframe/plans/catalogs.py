"""Catalog, search, settings and asset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.functions.text import non_empty
from curveframe.operators import assets, catalog, index_selection
from curveframe.operators.pages import missing_channels, select_channels
from curveframe.plans import tables as t
from curveframe.plans.registry import query
from curveframe.schema import DATASET_KEYS
from curveframe.sources.registry import source_format
from curveframe.sources.witsml import reference_attributes

_FOUND = "name ILIKE '%an%er%' OR object_type ILIKE '%an%er%' OR native_id ILIKE '%an%er%'"
SEARCH_TERM = "an%er"


@query(
    "WITH " + t.OBJECTS + f"""
SELECT id, object_type, native_id, name, parent_native_id FROM ob WHERE {_FOUND}
ORDER BY object_type, name, id LIMIT 50 OFFSET 100"""
)
def metadata_search_page(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.object_page(t.document_objects(spark, folder), 2, 50, SEARCH_TERM)


@query("WITH " + t.OBJECTS + f"\nSELECT count(*) AS total FROM ob WHERE {_FOUND}")
def metadata_search_total(spark: SparkSession, folder: str) -> DataFrame:
    found = catalog.search_objects(t.document_objects(spark, folder), SEARCH_TERM)
    return found.agg(F.count(F.lit(1)).alias("total"))


@query(
    "WITH " + t.OBJECTS + f""", placed AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY object_type, name, id) AS place,
    count(*) OVER (PARTITION BY document_id) AS total FROM ob WHERE {_FOUND})
SELECT document_id, place, total, id, object_type, native_id, name, parent_native_id
FROM placed WHERE place BETWEEN 21 AND 40"""
)
def object_pages_by_document(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.object_pages_by_document(t.document_objects(spark, folder), 1, 20, SEARCH_TERM)


@query(
    "WITH " + t.PARTS + """
SELECT * FROM pt WHERE contains(lower(concat_ws(' ', mnemonic, description, unit)), 'ring economy')"""
)
def curve_search(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.search_curves(t.part_channels(spark, folder), "  Ring ECONOMY ")


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as stored channels: some of them arrays, texts or without extremes."""
    size = F.col("p_size")
    return t.table(spark, folder, "part").select(
        F.lit("part").alias("document_id"),
        F.lower("p_brand").alias("dataset_id"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("channel_id"),
        F.col("p_partkey").cast("int").alias("position"),
        F.col("p_name").alias("mnemonic"),
        F.when(size % 4 == 0, "zarr").otherwise("parquet").alias("storage_kind"),
        F.when(size % 4 == 0, F.array(size)).otherwise(F.array().cast("array<int>")).alias("sample_shape"),
        F.when(size % 7 == 0, "text").otherwise("numeric").alias("data_type"),
        F.when(size % 3 > 0, F.col("p_retailprice")).alias("minimum"),
        F.when(size % 3 > 1, F.col("p_retailprice") + 1).alias("maximum"),
    )


_CHANNELS = """
pc AS (
  SELECT 'part' AS document_id, lower(p_brand) AS dataset_id, 'part-' || p_partkey AS channel_id,
    p_partkey::INT AS position, p_name AS mnemonic,
    CASE WHEN p_size % 4 = 0 THEN 'zarr' ELSE 'parquet' END AS storage_kind,
    p_size % 4 = 0 AS is_array, CASE WHEN p_size % 7 = 0 THEN 'text' ELSE 'numeric' END AS data_type,
    CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS minimum,
    CASE WHEN p_size % 3 > 1 THEN p_retailprice + 1 END AS maximum
  FROM part
)"""
_READABLE = "storage_kind = 'parquet' AND NOT is_array AND data_type = 'numeric'"


@query(
    "WITH " + _CHANNELS + f"""
SELECT document_id, dataset_id, channel_id, rn AS request_position FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, dataset_id ORDER BY position) - 1 AS rn
  FROM pc WHERE {_READABLE}) WHERE rn < 16"""
)
def default_page_channels(spark: SparkSession, folder: str) -> DataFrame:
    chosen = select_channels(_channels(spark, folder), default_limit=16)
    return chosen.select(*DATASET_KEYS, "channel_id", "request_position")


WANTED = [f"part-{key}" for key in (17, 3, 40, 8, 12)]


@query(
    "WITH " + _CHANNELS + f"""
SELECT DISTINCT d.document_id, d.dataset_id, w.channel_id,
  'Scalar curves were not found: ' || w.channel_id AS message
FROM pc d, (SELECT unnest({WANTED}) AS channel_id) w
WHERE d.storage_kind = 'parquet' AND NOT d.is_array AND d.data_type = 'numeric' AND NOT EXISTS (
  SELECT 1 FROM pc e WHERE e.dataset_id = d.dataset_id AND e.channel_id = w.channel_id
    AND e.storage_kind = 'parquet' AND NOT e.is_array AND e.data_type = 'numeric')"""
)
def missing_page_channels(spark: SparkSession, folder: str) -> DataFrame:
    return missing_channels(_channels(spark, folder), WANTED)


@query(
    "WITH " + _CHANNELS + """
SELECT document_id, dataset_id, channel_id FROM pc
WHERE storage_kind = 'parquet' AND NOT is_array AND (minimum IS NOT NULL OR maximum IS NOT NULL)"""
)
def displayable_curves(spark: SparkSession, folder: str) -> DataFrame:
    return _channels(spark, folder).where(catalog.is_displayable()).select(*DATASET_KEYS, "channel_id")


# Suppliers as datasets of a nation, the parts they ship as channels, their line
# items as previews and their orders' customers as objects.
_CATALOG = """
ds AS (
  SELECT 'nation-' || s_nationkey AS document_id, 'supplier-' || s_suppkey AS dataset_id,
    s_suppkey::INT AS position, s_name AS name,
    CASE WHEN s_suppkey % 4 = 0 THEN 'absolute_utc' WHEN s_suppkey % 4 = 1 THEN 'elapsed'
      WHEN s_suppkey % 4 = 2 THEN 'lunar' END AS ref,
    CASE WHEN s_suppkey % 6 > 0 THEN 0.0::DOUBLE END AS index_minimum, s_acctbal AS index_maximum
  FROM supplier),
lc AS (
  SELECT 'supplier-' || l_suppkey AS dataset_id, 'part-' || l_partkey AS channel_id,
    count(*) AS previews FROM lineitem GROUP BY ALL),
cc AS (
  SELECT lc.dataset_id, count(*) AS curve_count,
    count(*) FILTER (WHERE storage_kind = 'parquet' AND NOT is_array) AS scalar_curve_count,
    count(*) FILTER (WHERE storage_kind = 'parquet' AND NOT is_array) AS displayable_count,
    sum(previews)::BIGINT AS preview_count
  FROM lc JOIN pc USING (channel_id) GROUP BY lc.dataset_id),
vs AS (
  SELECT 'supplier-' || (event_id % 1000) AS dataset_id, arg_max(event_type, event_id) AS mode,
    arg_max(value, event_id) AS anchor
  FROM events GROUP BY ALL),
overview AS (
  SELECT ds.document_id, ds.dataset_id, position, name, index_minimum, index_maximum,
    CASE WHEN ref IN ('absolute_utc', 'elapsed') THEN ref ELSE 'none' END AS time_index_reference,
    coalesce(curve_count, 0) AS curve_count, coalesce(scalar_curve_count, 0) AS scalar_curve_count,
    coalesce(displayable_count, 0) AS displayable_count, coalesce(preview_count, 0) AS preview_count,
    coalesce(mode, CASE WHEN ref = 'absolute_utc' THEN 'clock' ELSE 'elapsed' END) AS time_display_mode,
    'utc' AS time_zone, anchor AS manual_anchor_index, NULL::DOUBLE AS manual_anchor_timestamp
  FROM ds LEFT JOIN cc USING (dataset_id) LEFT JOIN vs USING (dataset_id))"""


def _catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    key = F.col("s_suppkey")
    reference = (
        F.when(key % 4 == 0, "absolute_utc").when(key % 4 == 1, "elapsed").when(key % 4 == 2, "lunar")
    )
    datasets = t.table(spark, folder, "supplier").select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("document_id"),
        F.concat(F.lit("supplier-"), key.cast("string")).alias("dataset_id"),
        key.cast("int").alias("position"),
        F.col("s_name").alias("name"),
        F.when(key % 6 > 0, F.lit(0.0)).alias("index_minimum"),
        F.col("s_acctbal").alias("index_maximum"),
        F.to_json(F.struct(reference.alias("time_index_reference"))).alias("native_metadata"),
    )
    keys = datasets.select(*DATASET_KEYS)
    items = t.table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("channel_id"),
    )
    previews = items.join(keys, "dataset_id")
    kinds = _channels(spark, folder).drop("document_id", "dataset_id")
    channels = previews.distinct().join(kinds, "channel_id")
    events = t.table(spark, folder, "events")
    settings = events.select(
        F.concat(F.lit("supplier-"), (F.col("event_id") % 1000).cast("string")).alias("dataset_id"),
        F.col("event_type").alias("time_display_mode"),
        F.lit("utc").alias("time_zone"),
        F.col("value").alias("manual_anchor_index"),
        F.lit(None).cast("double").alias("manual_anchor_timestamp"),
        F.col("event_id").alias("version"),
    ).join(keys, "dataset_id")
    return {"datasets": datasets, "channels": channels, "previews": previews, "settings": settings}


def _overview(spark: SparkSession, folder: str) -> DataFrame:
    tables = _catalog(spark, folder)
    return catalog.dataset_overview(
        tables["datasets"], tables["channels"], tables["previews"], tables["settings"]
    )


@query("WITH " + _CHANNELS + "," + _CATALOG + "\nSELECT * FROM overview")
def catalog_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder)


@query(
    "WITH " + _CHANNELS + "," + _CATALOG + """,
src AS (
  SELECT 'nation-' || n_nationkey AS document_id, n_name AS file_name FROM nation),
obj AS (SELECT 'nation-' || c_nationkey AS document_id, count(*) AS n FROM customer GROUP BY ALL),
warn AS (
  SELECT 'nation-' || s_nationkey AS document_id, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY ALL),
tot AS (
  SELECT document_id, count(*) AS dataset_count, sum(scalar_curve_count)::BIGINT AS scalar_curve_count
  FROM overview GROUP BY ALL)
SELECT document_id, file_name, coalesce(dataset_count, 0) AS dataset_count,
  coalesce(scalar_curve_count, 0) AS scalar_curve_count, coalesce(obj.n, 0) AS preserved_object_count,
  coalesce(warn.n, 0) AS warning_count
FROM src LEFT JOIN tot USING (document_id) LEFT JOIN obj USING (document_id)
  LEFT JOIN warn USING (document_id)"""
)
def document_summary(spark: SparkSession, folder: str) -> DataFrame:
    def of(name: str, key: str) -> DataFrame:
        return t.table(spark, folder, name).withColumn(
            "document_id", F.concat(F.lit("nation-"), F.col(key).cast("string"))
        )

    sources = of("nation", "n_nationkey").select("document_id", F.col("n_name").alias("file_name"))
    warnings = of("supplier", "s_nationkey").where(F.col("s_acctbal") < 0)
    return catalog.document_overview(
        sources, _overview(spark, folder), of("customer", "c_nationkey"), warnings
    )


@query(
    "WITH " + _CHANNELS + "," + _CATALOG + """
SELECT document_id,
  arg_min(dataset_id, position) FILTER (WHERE scalar_curve_count > 0) AS first_scalar_dataset,
  arg_min(dataset_id, position) FILTER (WHERE index_maximum > index_minimum AND displayable_count > 0)
    AS first_displayable_dataset
FROM overview GROUP BY document_id"""
)
def default_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.default_datasets(_overview(spark, folder))


@query(
    """SELECT 'events' AS document_id, 'user-' || user_id AS dataset_id,
  arg_max(CASE WHEN event_type = 'click' THEN 'clock' ELSE 'elapsed' END, event_id) AS time_display_mode,
  arg_max(CASE WHEN event_type = 'view' THEN 'local' ELSE 'utc' END, event_id) AS time_zone,
  max_by(v.anchor, event_id)[1] AS manual_anchor_index, arg_max(epoch_us(ts) / 1e6, event_id) AS manual_anchor_timestamp,
  max(event_id) AS version
FROM (SELECT *, {'anchor': [CASE WHEN event_id % 3 > 0 THEN value END]} AS v FROM events)
GROUP BY user_id"""
)
def view_settings_latest(spark: SparkSession, folder: str) -> DataFrame:
    events = t.table(spark, folder, "events")
    settings = events.select(
        F.lit("events").alias("document_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.when(F.col("event_type") == "click", "clock").otherwise("elapsed").alias("time_display_mode"),
        F.when(F.col("event_type") == "view", "local").otherwise("utc").alias("time_zone"),
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("manual_anchor_index"),
        t.epoch_seconds("ts").alias("manual_anchor_timestamp"),
        F.col("event_id").alias("version"),
    )
    return catalog.latest_settings(settings)


@query(
    """SELECT 'page-' || page_id AS id, 'PAGE' AS object_type, url AS native_id, url AS name,
  NULL::VARCHAR AS parent_native_id, p AS metadata_path,
  CASE WHEN p LIKE '%.xml' THEN 'application/xml' ELSE 'text/plain' END AS content_type,
  NULL::VARCHAR AS content_json, html AS "text", strlen(html)::BIGINT AS size_bytes,
  strlen(html) > 262144 AS truncated
FROM (SELECT *, 'pages/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.json' WHEN page_id % 3 = 1
  THEN '.xml' ELSE '.txt' END AS p FROM pages)"""
)
def object_details(spark: SparkSession, folder: str) -> DataFrame:
    pages = t.table(spark, folder, "pages")
    key = F.col("page_id")
    ending = F.when(key % 3 == 0, ".json").when(key % 3 == 1, ".xml").otherwise(".txt")
    objects = pages.select(
        F.concat(F.lit("page-"), key.cast("string")).alias("id"),
        F.lit("PAGE").alias("object_type"),
        F.col("url").alias("native_id"),
        F.col("url").alias("name"),
        F.lit(None).cast("string").alias("parent_native_id"),
        F.concat(F.lit("pages/"), key.cast("string"), ending).alias("metadata_path"),
        F.col("html").alias("payload"),
    )
    return catalog.object_details(objects)


@query(
    """SELECT event_id, json_extract_string(m, '$.k') AS k,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS entries
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS m FROM events)"""
)
def metadata_json(spark: SparkSession, folder: str) -> DataFrame:
    # Every fifth text is a JSON list, which reads as an empty map.
    text = F.when(t.every("event_id", 5), F.concat(F.lit("["), "props", F.lit("]"))).otherwise(
        F.col("props")
    )
    events = t.table(spark, folder, "events").withColumn("m", catalog.metadata_map(text))
    return events.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("entries"))


@query(
    """SELECT 'order-' || l_orderkey AS document_id, string_agg(v, ', ' ORDER BY v) AS source_version
FROM (SELECT DISTINCT l_orderkey, l_returnflag || '.' || l_linestatus AS v FROM lineitem)
GROUP BY l_orderkey"""
)
def version_label(spark: SparkSession, folder: str) -> DataFrame:
    versions = t.table(spark, folder, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.concat_ws(".", "l_returnflag", "l_linestatus").alias("version"),
    )
    return catalog.version_labels(versions)


@query(
    """SELECT 'nation-' || c_nationkey AS document_id,
  coalesce(arg_min(c_name, c_custkey) FILTER (WHERE c_custkey % 3 = 2), 'Unknown well') AS first_name
FROM customer GROUP BY c_nationkey"""
)
def first_well_name(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    named = t.table(spark, folder, "customer").select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("document_id"),
        key.alias("position"),
        F.when(key % 3 == 0, "  ").when(key % 3 == 2, F.col("c_name")).alias("name"),
    )
    return catalog.first_names(named, F.lit("Unknown well"))


@query(
    """SELECT 'nation-' || n_nationkey AS source_object_id, r_name AS target_native_id,
  'parent' AS relationship_type FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier-' || s_suppkey, n_name, 'parent' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer-' || c_custkey, n_name, 'parent' FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def relationship_edges(spark: SparkSession, folder: str) -> DataFrame:
    nation = t.table(spark, folder, "nation")
    region = t.table(spark, folder, "region")
    parents = [
        ("nation", nation, "n_nationkey", "n_regionkey", region, "r_regionkey", "r_name"),
        ("supplier", None, "s_suppkey", "s_nationkey", nation, "n_nationkey", "n_name"),
        ("customer", None, "c_custkey", "c_nationkey", nation, "n_nationkey", "n_name"),
    ]
    edges = None
    for kind, child, own, link, parent, key, name in parents:
        child = t.table(spark, folder, kind) if child is None else child
        part = child.join(parent.select(F.col(key).alias("up"), F.col(name).alias("target")),
                          F.col(link) == F.col("up")).select(
            F.concat(F.lit(f"{kind}-"), F.col(own).cast("string")).alias("source_object_id"),
            F.col("target").alias("target_native_id"),
            F.lit("parent").alias("relationship_type"),
        )
        edges = part if edges is None else edges.unionByName(part)
    return edges


@query(
    r"""SELECT DISTINCT page_id, 'a' AS name, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS target
FROM pages"""
)
def reference_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Link attributes of whole pages, the way object references are collected."""
    tags = t.table(spark, folder, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(a\s[^>]*)>"), 1)).alias("attributes")
    )
    named = tags.withColumn("name", F.lit("a"))
    return reference_attributes(named, ["page_id"], wanted=r"(?i)(href)")


@query(
    "WITH " + t.PARTS + """, s AS (
  SELECT *, coalesce(nullif(replace(trim(regexp_replace(lower(mnemonic), '[^a-z0-9]+', '-', 'g'), '-'),
    '-', '_'), ''), 'item') AS slug FROM pt),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY document_id, dataset_id, slug ORDER BY position) = 1
    AND slug <> 'index' THEN slug ELSE slug || '_' || position END AS c FROM s)
SELECT document_id, dataset_id, channel_id, CASE WHEN row_number() OVER (
  PARTITION BY document_id, dataset_id, c ORDER BY position) = 1 THEN c ELSE c || '_' || position END AS column_name
FROM f"""
)
def unique_columns(spark: SparkSession, folder: str) -> DataFrame:
    named = index_selection.unique_column_names(t.part_channels(spark, folder))
    return named.select(*DATASET_KEYS, "channel_id", "column_name")


# Documents as packaged files: paths by source, some of them faulty.
_ASSETS = """
mf AS (
  SELECT lang AS document_id, p AS path, kind, strlen("text")::BIGINT + (doc_id % 31 = 0)::INT AS size_bytes,
    CASE WHEN doc_id % 37 = 0 THEN md5("text") ELSE sha256("text") END AS sha256
  FROM paths, (VALUES (1), (2)) AS copies(n) WHERE doc_id % 41 > 0 AND (n = 1 OR doc_id % 97 = 0)),
ac AS (
  SELECT lang AS document_id, p AS path, strlen("text")::BIGINT AS size_bytes, sha256("text") AS sha256
  FROM paths WHERE doc_id % 43 > 0)"""
_PATHS = """
paths AS (
  SELECT *, CASE WHEN doc_id % 53 = 0 THEN '../' ELSE '' END || source || '/' || doc_id ||
    CASE doc_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.zarr/0.bin' WHEN 2 THEN '.json' ELSE '.txt' END AS p,
    CASE doc_id % 4 WHEN 0 THEN 'scalar' WHEN 1 THEN 'array' ELSE 'metadata' END AS kind
  FROM documents)"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    ending = (
        F.when(key % 4 == 0, ".parquet")
        .when(key % 4 == 1, ".zarr/0.bin")
        .when(key % 4 == 2, ".json")
        .otherwise(".txt")
    )
    path = F.concat(
        F.when(key % 53 == 0, "../").otherwise(""), "source", F.lit("/"), key.cast("string"), ending
    )
    return t.table(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("document_id"),
        path.alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


def _manifest(files: DataFrame) -> DataFrame:
    """Declared assets: some wrong sizes and checksums, some left out, some twice."""
    key = F.col("doc_id")
    copies = F.when(key % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return files.where(key % 41 > 0).select(
        "document_id",
        "path",
        assets.asset_kind("path").alias("kind"),
        (F.octet_length("content") + F.when(key % 31 == 0, 1).otherwise(0)).cast("bigint").alias("size_bytes"),
        F.when(key % 37 == 0, F.md5("content")).otherwise(F.sha2("content", 256)).alias("sha256"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _actual(files: DataFrame) -> DataFrame:
    return files.where(F.col("doc_id") % 43 > 0).select(
        "document_id",
        "path",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


@query(
    "WITH " + _PATHS + """
SELECT lang AS document_id, p AS path, kind, strlen("text")::BIGINT AS size_bytes, sha256("text") AS sha256
FROM paths"""
)
def asset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return assets.build_manifest(assets.with_checksums(_files(spark, folder)))


_ERRORS = "WITH " + _PATHS + "," + _ASSETS + """,
d AS (SELECT document_id, path, count(*) AS n, max(size_bytes) AS size, max(sha256) AS sha FROM mf GROUP BY ALL),
a AS (SELECT document_id, path, count(*) AS n, max(size_bytes) AS size, max(sha256) AS sha FROM ac GROUP BY ALL),
j AS (
  SELECT document_id, path, d.n AS dn, a.n AS an, d.size AS ds, a.size AS asz, d.sha AS dh, a.sha AS ah
  FROM d FULL JOIN a USING (document_id, path)),
errors AS (
  SELECT document_id, path, 'Unsafe or duplicate member: ' || path AS error FROM j WHERE path LIKE '../%' OR an > 1
  UNION ALL SELECT document_id, path, 'duplicate asset path: ' || path FROM j WHERE dn > 1
  UNION ALL SELECT document_id, path, 'missing asset: ' || path FROM j WHERE an IS NULL
  UNION ALL SELECT document_id, path, 'undeclared asset: ' || path FROM j WHERE dn IS NULL
  UNION ALL SELECT document_id, path, path || ': size mismatch' FROM j WHERE ds <> asz
  UNION ALL SELECT document_id, path, path || ': checksum mismatch' FROM j WHERE dh <> ah)
"""  # fmt: skip


@query(_ERRORS + "SELECT * FROM errors")
def asset_verify(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return assets.verify_assets(_manifest(files), _actual(files))


@query(
    _ERRORS + """SELECT document_id, asset_count, coalesce(n, 0) AS error_count, coalesce(n, 0) = 0 AS valid
FROM (SELECT document_id, count(*) AS asset_count FROM mf GROUP BY ALL)
LEFT JOIN (SELECT document_id, count(*) AS n FROM errors GROUP BY ALL) USING (document_id)"""
)
def asset_validity(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    manifest = _manifest(files)
    return assets.verification(manifest, assets.verify_assets(manifest, _actual(files)))


@query("WITH " + _PATHS + "," + _ASSETS + "\nSELECT document_id, path FROM mf EXCEPT SELECT document_id, path FROM ac")
def missing_assets(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return assets.missing_assets(_manifest(files), _actual(files)).distinct()


@query("WITH " + _PATHS + "," + _ASSETS + "\nSELECT document_id, path FROM ac EXCEPT SELECT document_id, path FROM mf")
def undeclared_assets(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return assets.undeclared_assets(_manifest(files), _actual(files))


@query(
    "WITH " + _PATHS + """
SELECT lang AS document_id, p AS path, kind,
  strlen("text")::BIGINT + (doc_id % 10 = 0)::INT AS size_bytes,
  CASE WHEN doc_id % 10 = 0 THEN sha256("text" || '!') ELSE sha256("text") END AS sha256 FROM paths"""
)
def manifest_refresh(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    edited = files.where(t.every("doc_id", 10)).withColumn(
        "content", F.concat("content", F.encode(F.lit("!"), "UTF-8"))
    )
    fresh = edited.select(
        "document_id",
        "path",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    return assets.refresh_manifest(assets.build_manifest(assets.with_checksums(files)), fresh)


@query(
    """SELECT doc_id, name, strlen("text")::BIGINT AS file_size_bytes, sha256("text") AS sha256,
  CASE doc_id % 6 WHEN 0 THEN 'LAS' WHEN 1 THEN 'DLIS' WHEN 2 THEN 'WITSML' WHEN 3 THEN 'WITSML' END AS source_format
FROM (SELECT *, source || '-' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.LAS' WHEN 1 THEN '.dlis' WHEN 2 THEN '.xml'
  WHEN 3 THEN '.Epc' WHEN 4 THEN '.txt' ELSE '' END AS name FROM documents)"""
)
def source_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as input files: size, checksum and format by suffix."""
    key = F.col("doc_id") % 6
    ending = (
        F.when(key == 0, ".LAS").when(key == 1, ".dlis").when(key == 2, ".xml")
        .when(key == 3, ".Epc").when(key == 4, ".txt").otherwise("")
    )
    named = t.table(spark, folder, "documents").withColumn(
        "name", F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), ending)
    )
    return named.select(
        "doc_id",
        "name",
        F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"),
        source_format("name").alias("source_format"),
    )


@query(
    """SELECT 'frame-' || (p_partkey % 100) AS source_object_id,
  CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_brand || '/' || p_partkey END AS target_native_id,
  'contains' AS relationship_type, p_type AS document_id FROM part"""
)
def frame_edges(spark: SparkSession, folder: str) -> DataFrame:
    fingerprint = F.when(F.col("p_size") % 5 > 0, F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")))
    channels = t.table(spark, folder, "part").select(
        F.col("p_type").alias("document_id"),
        F.concat(F.lit("frame-"), (F.col("p_partkey") % 100).cast("string")).alias("frame_object_id"),
        non_empty("p_name").alias("mnemonic"),
        F.to_json(F.struct(fingerprint.alias("fingerprint"))).alias("native_metadata"),
    )
    return catalog.frame_edges(channels)
