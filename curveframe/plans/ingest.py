"""Ingest queries: files are spelled out from table rows and read back.

Every row of ``embeddings`` becomes the text of one small curve file, every row
of ``customer`` one object document, so the work grows with the tables and stays
row-local up to the parsers under test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.plans import tables as t
from curveframe.plans.registry import query
from curveframe.schema import DATASET_KEYS
from curveframe.sources import las, witsml
from curveframe.sources.frames import ingest_array_collection, ingest_frames

# Milli-units of an element, so that texts hold whole numbers.
_MILLI = "round(embedding[i] * 1000)::INT"
_VALUES = f"""
vals AS (
  SELECT vec_id, 'vec-' || vec_id AS document_id, i, {_MILLI} AS milli, len(embedding) AS n
  FROM embeddings, range(1, (SELECT max(len(embedding)) FROM embeddings) + 1) r(i) WHERE i <= len(embedding))"""


def _milli(element: Column) -> Column:
    return F.round(element * 1000).cast("int")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "embeddings").select(
        "vec_id",
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("document_id"),
        F.transform("embedding", lambda element: _milli(element.cast("float"))).alias("milli"),
    )


def las_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One LAS file per vector. By ``vec_id % 3`` the index is a depth, one of two
    depths, or a time in milliseconds; every tenth value is the null sentinel."""
    kind = F.col("vec_id") % 3
    second = F.when(kind == 1, " TVD.M : vertical depth").otherwise(" CALI.IN : caliper")
    first = F.when(kind == 2, " TIME.MS : elapsed").otherwise(" DEPT.M : depth")

    def line(element: Column, place: Column) -> Column:
        other = F.when(kind == 1, place * 2).otherwise(F.pmod(place * 7, F.lit(5)))
        value = F.when(place % 10 == 9, F.lit("-999.25")).otherwise(element.cast("string"))
        return F.format_string("  %d   %d %s", place, other, value)

    header = F.concat_ws(
        "\n",
        F.lit("~Version information"),
        F.lit(" VERS. 2.0 : version"),
        F.lit(" WRAP. NO : one line per step"),
        F.lit("# a comment"),
        F.lit("~Well"),
        F.concat(F.lit(" WELL. Well "), F.col("vec_id").cast("string"), F.lit(" : name")),
        F.lit(" NULL. -999.25 : null"),
        F.lit("~Curve"),
        first,
        second,
        F.lit(" GR.GAPI 30 : gamma ray"),
        F.lit("~ASCII"),
    )
    return _spread(
        _vectors(spark, folder).select(
            "document_id",
            F.concat("document_id", F.lit(".las")).alias("file_name"),
            F.lit(4096).cast("bigint").alias("file_size_bytes"),
            F.concat_ws("\n", header, F.array_join(F.transform("milli", line), "\n")).alias("content"),
        )
    )


def _spread(documents: DataFrame) -> DataFrame:
    """Documents over all tasks, as a folder of files would be; the texts are made once."""
    return documents.repartition("document_id")


_LAS_DATASET = "'dataset-las-' || left(document_id, 12) AS dataset_id"


@query(
    "WITH " + _VALUES + f"""
SELECT document_id, {_LAS_DATASET}, p AS position, i - 1 AS ordinal,
  CASE p WHEN 0 THEN (i - 1)::VARCHAR WHEN 1 THEN o::VARCHAR
    ELSE CASE WHEN i % 10 = 0 THEN '-999.25' ELSE milli::VARCHAR END END AS raw,
  CASE p WHEN 0 THEN (i - 1)::DOUBLE WHEN 1 THEN o::DOUBLE
    ELSE CASE WHEN i % 10 > 0 THEN milli::DOUBLE END END AS value
FROM (SELECT *, CASE WHEN vec_id % 3 = 1 THEN (i - 1) * 2 ELSE ((i - 1) * 7) % 5 END AS o FROM vals), range(3) r(p)"""
)
def las_cells(spark: SparkSession, folder: str) -> DataFrame:
    return las.las_cells(las.parse_las(las_documents(spark, folder)))


@query(
    """SELECT 'vec-' || vec_id AS document_id, s.section, s.position, s.mnemonic, s.unit, s.value, s.description
FROM (SELECT vec_id, unnest([
  {'section': 'version', 'position': 0, 'mnemonic': 'VERS', 'unit': '', 'value': '2.0', 'description': 'version'},
  {'section': 'version', 'position': 1, 'mnemonic': 'WRAP', 'unit': '', 'value': 'NO',
    'description': 'one line per step'},
  {'section': 'well', 'position': 0, 'mnemonic': 'WELL', 'unit': '', 'value': 'Well ' || vec_id,
    'description': 'name'},
  {'section': 'well', 'position': 1, 'mnemonic': 'NULL', 'unit': '', 'value': '-999.25', 'description': 'null'},
  {'section': 'curve', 'position': 0, 'mnemonic': CASE WHEN vec_id % 3 = 2 THEN 'TIME' ELSE 'DEPT' END,
    'unit': CASE WHEN vec_id % 3 = 2 THEN 'MS' ELSE 'M' END, 'value': '',
    'description': CASE WHEN vec_id % 3 = 2 THEN 'elapsed' ELSE 'depth' END},
  {'section': 'curve', 'position': 1, 'mnemonic': CASE WHEN vec_id % 3 = 1 THEN 'TVD' ELSE 'CALI' END,
    'unit': CASE WHEN vec_id % 3 = 1 THEN 'M' ELSE 'IN' END, 'value': '',
    'description': CASE WHEN vec_id % 3 = 1 THEN 'vertical depth' ELSE 'caliper' END},
  {'section': 'curve', 'position': 2, 'mnemonic': 'GR', 'unit': 'GAPI', 'value': '30',
    'description': 'gamma ray'}]) AS s FROM embeddings)"""
)
def las_header_items(spark: SparkSession, folder: str) -> DataFrame:
    return las.header_items(las.parse_las(las_documents(spark, folder)))


@query(
    f"""SELECT document_id, {_LAS_DATASET}, c.candidate_id, c.mnemonic, c.unit, c.kind, c.time_reference,
  1.0::DOUBLE AS valid_ratio, 1.0::DOUBLE AS monotonic_ratio
FROM (SELECT 'vec-' || vec_id AS document_id, unnest(CASE vec_id % 3
  WHEN 0 THEN [{{'candidate_id': 'curve:0', 'mnemonic': 'DEPT', 'unit': 'M', 'kind': 'measured_depth',
    'time_reference': 'none'}}]
  WHEN 1 THEN [{{'candidate_id': 'curve:0', 'mnemonic': 'DEPT', 'unit': 'M', 'kind': 'measured_depth',
    'time_reference': 'none'}}, {{'candidate_id': 'curve:1', 'mnemonic': 'TVD', 'unit': 'M',
    'kind': 'true_vertical_depth', 'time_reference': 'none'}}]
  ELSE [{{'candidate_id': 'curve:0', 'mnemonic': 'TIME', 'unit': 's', 'kind': 'time',
    'time_reference': 'elapsed'}}] END) AS c FROM embeddings)"""
)
def las_candidates(spark: SparkSession, folder: str) -> DataFrame:
    tables = las.ingest_las(las_documents(spark, folder))
    return tables.candidates.select(
        *DATASET_KEYS, "candidate_id", "mnemonic", "unit", "kind", "time_reference", "valid_ratio",
        "monotonic_ratio",
    )


@query(
    """SELECT 'vec-' || vec_id AS document_id, 'vec-' || vec_id || '.las' AS file_name,
  CASE WHEN vec_id % 3 = 1 THEN 'INDEX_SELECTION_REQUIRED' ELSE 'OK' END AS status,
  CASE WHEN vec_id % 3 = 1 THEN 'This LAS file has multiple credible index curves. Select the index to use.' END
    AS message FROM embeddings"""
)
def las_status(spark: SparkSession, folder: str) -> DataFrame:
    return las.ingest_las(las_documents(spark, folder)).status


_LAS_LONG = "WITH " + _VALUES + f""", long AS (
  SELECT document_id, {_LAS_DATASET}, vec_id, i - 1 AS ordinal,
    (i - 1) * CASE WHEN vec_id % 3 = 2 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS "index",
    CASE p WHEN 1 THEN CASE WHEN vec_id % 3 = 1 THEN 'curve-1-tvd' ELSE 'curve-1-cali' END
      ELSE 'curve-2-gr' END AS channel_id,
    CASE p WHEN 1 THEN CASE WHEN vec_id % 3 = 1 THEN (i - 1) * 2 ELSE ((i - 1) * 7) % 5 END::DOUBLE
      ELSE CASE WHEN i % 10 > 0 THEN milli::DOUBLE END END AS value
  FROM vals, range(1, 3) r(p))"""


@query(_LAS_LONG + '\nSELECT document_id, dataset_id, channel_id, ordinal, "index", value FROM long')
def las_samples(spark: SparkSession, folder: str) -> DataFrame:
    tables = las.ingest_las(las_documents(spark, folder), take_first=True)
    return tables.samples.drop("text_value")


@query(
    _LAS_LONG + """
SELECT document_id, dataset_id, channel_id, min(value) AS minimum, max(value) AS maximum,
  count(*) AS sample_count, count(*) - count(value) AS null_count,
  CASE WHEN channel_id = 'curve-2-gr' THEN 'gr' WHEN channel_id = 'curve-1-tvd' THEN 'tvd' ELSE 'cali' END
    AS column_name, CASE WHEN channel_id = 'curve-2-gr' THEN 1 ELSE 0 END AS position
FROM long GROUP BY ALL"""
)
def las_channels(spark: SparkSession, folder: str) -> DataFrame:
    tables = las.ingest_las(las_documents(spark, folder), take_first=True)
    return tables.channels.select(
        *DATASET_KEYS, "channel_id", "minimum", "maximum", "sample_count", "null_count",
        F.get_json_object("native_metadata", "$.parquet_column").alias("column_name"), "position",
    )


@query(
    _LAS_LONG + """
SELECT document_id, dataset_id, 'LAS 2.0' AS name, 'Well ' || vec_id AS well_name,
  count(DISTINCT ordinal) AS row_count, CASE WHEN vec_id % 3 = 2 THEN 'TIME' ELSE 'DEPT' END AS index_mnemonic,
  CASE WHEN vec_id % 3 = 2 THEN 's' ELSE 'M' END AS index_unit,
  CASE WHEN vec_id % 3 = 2 THEN 'time' ELSE 'measured_depth' END AS index_kind,
  min("index") AS index_minimum, max("index") AS index_maximum
FROM long GROUP BY document_id, dataset_id, vec_id"""
)
def las_datasets(spark: SparkSession, folder: str) -> DataFrame:
    tables = las.ingest_las(las_documents(spark, folder), take_first=True)
    return tables.datasets.select(
        *DATASET_KEYS, "name", "well_name", "row_count", "index_mnemonic", "index_unit", "index_kind",
        "index_minimum", "index_maximum",
    )


def _xml_documents(rows: DataFrame, content: Column) -> DataFrame:
    return _spread(
        rows.select(
            "document_id",
            F.concat("document_id", F.lit(".xml")).alias("file_name"),
            F.lit(4096).cast("bigint").alias("file_size_bytes"),
            content.alias("content"),
        )
    )


def log_documents(spark: SparkSession, folder: str) -> DataFrame:
    """First-generation log per vector; odd vectors have a time index, short rows lack a cell."""
    vectors = _vectors(spark, folder)
    timed = F.col("vec_id") % 2 == 1

    def line(element: Column, place: Column) -> Column:
        index = F.when(
            timed,
            F.concat(
                F.lit("2024-01-01T"),
                F.lpad(F.floor(place / 60).cast("string"), 2, "0"),
                F.lit(":"),
                F.lpad((place % 60).cast("string"), 2, "0"),
                F.lit(":00Z"),
            ),
        ).otherwise(place.cast("string"))
        tail = F.when(place % 8 == 7, F.lit("")).otherwise(
            F.concat(F.lit(","), F.when(place % 5 == 4, F.lit("-999.250")).otherwise((place * 3).cast("string")))
        )
        return F.concat(F.lit("<w:data>"), index, F.lit(", "), element.cast("string"), tail, F.lit("</w:data>"))

    content = F.concat(
        F.lit('<?xml version="1.0"?>\n<!-- made of a vector -->\n'),
        F.lit('<w:logs xmlns:w="http://www.witsml.org/schemas/1series" version="1.4.1.1">'),
        F.concat(F.lit('<w:log uidWell="W" uid="L'), F.col("vec_id").cast("string"), F.lit('">')),
        F.lit("<w:nameWell>Well A</w:nameWell><w:name>vector log</w:name><w:indexType>"),
        F.when(timed, "date time").otherwise("measured depth"),
        F.lit("</w:indexType><w:logCurveInfo><w:mnemonic>GR</w:mnemonic><w:unit>gAPI</w:unit>"),
        F.lit("<w:curveDescription>gamma</w:curveDescription></w:logCurveInfo>"),
        F.lit("<w:logCurveInfo><w:mnemonic>CALI</w:mnemonic><w:nullValue>-999.25</w:nullValue></w:logCurveInfo>"),
        F.lit("<w:logData><w:mnemonicList>IDX, GR,CALI</w:mnemonicList><w:unitList>x,,in</w:unitList>"),
        F.array_join(F.transform("milli", line), ""),
        F.lit("</w:logData></w:log></w:logs>"),
    )
    return _xml_documents(vectors, content)


_LOG_LONG = "WITH " + _VALUES + """, long AS (
  SELECT document_id, 'dataset-witsml-log-1-' || left(document_id, 10) AS dataset_id, vec_id, i - 1 AS ordinal,
    CASE WHEN vec_id % 2 = 1 THEN 1704067200.0::DOUBLE + (i - 1) * 60 ELSE (i - 1)::DOUBLE END AS "index",
    p AS p, CASE p WHEN 1 THEN milli::DOUBLE ELSE
      CASE WHEN (i - 1) % 8 = 7 OR (i - 1) % 5 = 4 THEN NULL ELSE ((i - 1) * 3)::DOUBLE END END AS value
  FROM vals, range(1, 3) r(p)),
named AS (SELECT *, 'curve-' || dataset_id || CASE p WHEN 1 THEN '-1-gr' ELSE '-2-cali' END AS channel_id FROM long)"""


@query(_LOG_LONG + '\nSELECT document_id, dataset_id, channel_id, ordinal, "index", value FROM named')
def witsml_log_samples(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(log_documents(spark, folder))
    return witsml.ingest_column_logs(documents).samples.drop("text_value")


@query(
    _LOG_LONG + """
SELECT document_id, dataset_id, channel_id, CASE p WHEN 1 THEN 'gAPI' ELSE 'in' END AS unit,
  CASE p WHEN 1 THEN 'gamma' ELSE 'Imported WITSML curve' END AS description,
  min(value) AS minimum, max(value) AS maximum, count(*) AS sample_count, count(*) - count(value) AS null_count,
  'numeric' AS data_type
FROM named GROUP BY ALL"""
)
def witsml_log_channels(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(log_documents(spark, folder))
    return witsml.ingest_column_logs(documents).channels.select(
        *DATASET_KEYS, "channel_id", "unit", "description", "minimum", "maximum", "sample_count",
        "null_count", "data_type",
    )


@query(
    _LOG_LONG + """
SELECT document_id, dataset_id, 'vector log' AS name, 'Well A' AS well_name, 'IDX' AS index_mnemonic,
  'x' AS index_unit, CASE WHEN vec_id % 2 = 1 THEN 'time' ELSE 'measured_depth' END AS index_kind,
  count(DISTINCT ordinal) AS row_count, min("index") AS index_minimum, max("index") AS index_maximum
FROM named GROUP BY document_id, dataset_id, vec_id"""
)
def witsml_log_datasets(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(log_documents(spark, folder))
    return witsml.ingest_column_logs(documents).datasets.select(
        *DATASET_KEYS, "name", "well_name", "index_mnemonic", "index_unit", "index_kind", "row_count",
        "index_minimum", "index_maximum",
    )


def set_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Second-generation log per vector: a scalar and a three-element list per row."""

    def row(element: Column, place: Column) -> Column:
        value = F.when(place % 6 == 5, F.lit("null")).otherwise(element.cast("string"))
        return F.format_string("[[%d],[%s,[%d,%d,%d]]]", place, value, place, place + 1, element)

    content = F.concat(
        F.lit('<Log schemaVersion="2.1" uuid="u-1" xmlns="http://www.energistics.org/energyml/data/witsmlv2">'),
        F.lit("<Citation><Title>Vector</Title></Citation><ChannelSet><Citation><Title>Main</Title></Citation>"),
        F.lit("<Index><Mnemonic>DEPTH</Mnemonic><IndexType>measured depth</IndexType><Uom>m</Uom></Index>"),
        F.lit("<Channel><Mnemonic>GR</Mnemonic><Uom>gAPI</Uom></Channel><Data><Data><![CDATA[["),
        F.array_join(F.transform("milli", row), ","),
        F.lit("]]]></Data></Data></ChannelSet></Log>"),
    )
    return _xml_documents(_vectors(spark, folder), content)


_SET_DATASET = "'dataset-witsml2-log-1-1-' || left(document_id, 10)"


@query(
    "WITH " + _VALUES + f"""
SELECT document_id, {_SET_DATASET} AS dataset_id, 'curve-' || {_SET_DATASET} || '-1-gr' AS channel_id,
  i - 1 AS ordinal, (i - 1)::DOUBLE AS "index", CASE WHEN (i - 1) % 6 < 5 THEN milli::DOUBLE END AS value FROM vals"""
)
def witsml_set_samples(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(set_documents(spark, folder))
    return witsml.ingest_channel_sets(documents).samples.drop("text_value")


@query(
    "WITH " + _VALUES + f"""
SELECT document_id, {_SET_DATASET} AS dataset_id, 'curve-' || {_SET_DATASET} || '-1-gr' AS channel_id,
  'GR' AS mnemonic, 'gAPI' AS unit, 'parquet' AS storage_kind, 0 AS dimension,
  min(milli) FILTER (WHERE (i - 1) % 6 < 5)::DOUBLE AS minimum,
  max(milli) FILTER (WHERE (i - 1) % 6 < 5)::DOUBLE AS maximum,
  count(*) AS sample_count, count(*) FILTER (WHERE (i - 1) % 6 = 5) AS null_count FROM vals GROUP BY document_id
UNION ALL SELECT document_id, {_SET_DATASET}, 'curve-' || {_SET_DATASET} || '-2-channel-2', 'CHANNEL_2', '', 'zarr', 3,
  least(min(milli), 0)::DOUBLE, greatest(max(milli), max(i))::DOUBLE, count(*), 0 FROM vals GROUP BY document_id"""
)
def witsml_set_channels(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(set_documents(spark, folder))
    return witsml.ingest_channel_sets(documents).channels.select(
        *DATASET_KEYS, "channel_id", "mnemonic", "unit", "storage_kind",
        F.coalesce(F.get("sample_shape", F.lit(0)), F.lit(0)).alias("dimension"),
        "minimum", "maximum", "sample_count", "null_count",
    )


def broken_log_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Two logs per vector; by ``vec_id % 4`` the second lacks its lists, its rows, its row shape, or nothing."""
    key = F.col("vec_id").cast("string")
    kind = F.col("vec_id") % 4
    lists = F.when(kind == 0, F.lit("<mnemonicList> </mnemonicList>")).otherwise(F.lit("<mnemonicList>IDX,GR</mnemonicList>"))
    rows = F.when(kind == 1, F.lit("")).otherwise(F.lit("<data>1,2</data>"))
    columns = F.concat(F.lit("<logData>"), lists, rows, F.lit("</logData>"))
    shape = F.lit("<ChannelSet><Data><Data>[[1],[2]]</Data></Data></ChannelSet>")
    content = F.concat(
        F.lit('<logs xmlns="http://www.witsml.org/schemas/1series" note="a > b"><log uid="good"><logData>'),
        F.lit("<mnemonicList>IDX,GR</mnemonicList><data>1,2</data></logData></log>"),
        F.lit('<log uid="second '), key, F.lit(' > first">'), F.when(kind != 3, F.lit("<name>made</name>")).otherwise(""),
        F.when(kind == 2, shape).otherwise(columns),
        F.lit("</log></logs>"),
    )
    return _xml_documents(_vectors(spark, folder), content)


@query(
    """SELECT 'vec-' || vec_id AS document_id, 0 AS ordinal, 'WITSML log made could not be normalized: ' || CASE vec_id % 4
  WHEN 0 THEN 'The WITSML log does not define a mnemonic list.' WHEN 1 THEN 'The WITSML log does not contain data rows.'
  ELSE 'WITSML 2.x ChannelData rows have an unsupported shape.' END AS message FROM embeddings WHERE vec_id % 4 < 3"""
)
def witsml_log_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Logs that cannot be read are said so; the other logs of their documents are not lost."""
    return witsml.log_warnings(witsml.read_documents(broken_log_documents(spark, folder)))


@query(
    """SELECT 'vec-' || vec_id AS document_id, unnest(['good', 'second ' || vec_id || ' > first']) AS native_id FROM embeddings"""
)
def witsml_quoted_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Objects whose attributes hold the sign that ends a tag."""
    documents = witsml.read_documents(broken_log_documents(spark, folder))
    return witsml.ingest_objects(documents).objects.select("document_id", "native_id")


def trajectory_documents(spark: SparkSession, folder: str) -> DataFrame:
    def station(element: Column, place: Column) -> Column:
        azimuth = F.when(
            F.col("vec_id") % 2 == 0, F.concat(F.lit("<azi>"), (place * 2).cast("string"), F.lit("</azi>"))
        ).otherwise("")
        return F.concat(
            F.lit('<trajectoryStation><md uom="m">'), (place * 10).cast("string"),
            F.lit('</md><incl uom="dega">'), element.cast("string"), F.lit("</incl>"), azimuth,
            F.lit("</trajectoryStation>"),
        )

    content = F.concat(
        F.lit('<trajectorys xmlns="http://www.witsml.org/schemas/1series"><trajectory uid="T">'),
        F.lit("<nameWell>Well T</nameWell><name>path</name>"),
        F.array_join(F.transform("milli", station), ""),
        F.lit("</trajectory></trajectorys>"),
    )
    return _xml_documents(_vectors(spark, folder), content)


@query(
    "WITH " + _VALUES + """, d AS (
  SELECT *, 'dataset-witsml-trajectory-1-' || left(document_id, 10) AS dataset_id FROM vals)
SELECT document_id, dataset_id, 'curve-' || dataset_id || '-1-incl' AS channel_id, i - 1 AS ordinal,
  ((i - 1) * 10)::DOUBLE AS "index", milli::DOUBLE AS value FROM d
UNION ALL SELECT document_id, dataset_id, 'curve-' || dataset_id || '-2-azi', i - 1, ((i - 1) * 10)::DOUBLE,
  ((i - 1) * 2)::DOUBLE FROM d WHERE vec_id % 2 = 0"""
)
def witsml_trajectory_samples(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(trajectory_documents(spark, folder))
    return witsml.ingest_trajectories(documents).samples.drop("text_value")


def object_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Two wells per customer document, with references at several depths."""
    key = F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    content = F.concat(
        F.lit('<wells xmlns="http://www.witsml.org/schemas/1series"><well uid="w'), key,
        F.lit('"><name>'), F.col("c_name"), F.lit('</name><logData><data>1,2</data></logData><Wellbore uidRef="b'),
        nation, F.lit('"/><crs uidRef="c'), nation, F.lit('"><at uuid="'), key,
        F.lit('"/></crs></well><well><Uuid>second '), key,
        F.lit('</Uuid><crs uidRef="c'), nation, F.lit('"/><crs uidRef="c'), nation, F.lit('"/></well></wells>'),
    )
    rows = t.table(spark, folder, "customer").withColumn(
        "document_id", F.concat(F.lit("cust-"), key)
    )
    return _xml_documents(rows, content)


_OBJECT_ID = "'witsml-object-1-{n}-' || left('cust-' || c_custkey, 8)"


@query(
    f"""SELECT 'cust-' || c_custkey AS document_id, {_OBJECT_ID.format(n=1)} AS id, 'well' AS object_type,
  'w' || c_custkey AS native_id, c_name AS name, 'b' || c_nationkey AS parent_native_id,
  'metadata/witsml/objects/001-001-well.xml' AS metadata_path FROM customer
UNION ALL SELECT 'cust-' || c_custkey, {_OBJECT_ID.format(n=2)}, 'well', 'second ' || c_custkey,
  'second ' || c_custkey, NULL, 'metadata/witsml/objects/001-002-well.xml' FROM customer"""
)
def witsml_objects(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(object_documents(spark, folder))
    return witsml.ingest_objects(documents).objects.drop("payload")


@query(
    f"""SELECT 'cust-' || c_custkey AS document_id, {_OBJECT_ID.format(n=1)} AS source_object_id,
  e.target AS target_native_id, e.kind AS relationship_type
FROM (SELECT *, unnest([{{'kind': 'parent', 'target': 'b' || c_nationkey}}, {{'kind': 'Wellbore', 'target': 'b' ||
  c_nationkey}}, {{'kind': 'crs', 'target': 'c' || c_nationkey}}, {{'kind': 'at', 'target': c_custkey::VARCHAR}}]) AS e
  FROM customer)
UNION ALL SELECT 'cust-' || c_custkey, {_OBJECT_ID.format(n=2)}, 'c' || c_nationkey, 'crs' FROM customer"""
)
def witsml_relationships(spark: SparkSession, folder: str) -> DataFrame:
    documents = witsml.read_documents(object_documents(spark, folder))
    return witsml.ingest_objects(documents).relationships


@query(
    """SELECT 'cust-' || c_custkey AS document_id, 'wells' AS root_name,
  'http://www.witsml.org/schemas/1series' AS namespace, '1.4.1.1' AS version, NULL::VARCHAR AS problem FROM customer
UNION ALL SELECT 'page-' || page_id, 'html', '', '1.4.1.1', 'Could not parse page-' || page_id || '.xml' FROM pages"""
)
def witsml_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Version and namespace of object documents, and foreign documents as warnings."""
    pages = t.table(spark, folder, "pages").withColumn(
        "document_id", F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    )
    foreign = _xml_documents(pages, F.col("html"))
    both = object_documents(spark, folder).unionByName(foreign)
    return witsml.read_documents(both).select(
        "document_id", "root_name", "namespace", "version", "problem"
    )


@query(
    """SELECT 'cust-' || c_custkey AS document_id, '<wells xmlns="http://www.witsml.org/schemas/1series"><well uid="w'
  || c_custkey || '"><name>' || c_name || '</name><Wellbore uidRef="b' || c_nationkey || '"/><crs uidRef="c' ||
  c_nationkey || '"><at uuid="' || c_custkey || '"/></crs></well><well><Uuid>second ' || c_custkey ||
  '</Uuid><crs uidRef="c' || c_nationkey || '"/><crs uidRef="c' || c_nationkey || '"/></well></wells>' AS payload
FROM customer"""
)
def stripped_payload(spark: SparkSession, folder: str) -> DataFrame:
    return object_documents(spark, folder).select(
        "document_id", witsml.strip_bulk_data("content").alias("payload")
    )


def _frame(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as one decoded frame per label, and its channel metadata."""
    frame = t.table(spark, folder, "embeddings").select(
        F.lit("frames").alias("document_id"),
        F.concat(F.lit("frame-"), F.col("label").cast("string")).alias("dataset_id"),
        F.col("vec_id").alias("ordinal"),
        (F.col("vec_id") * 0.5).alias("TDEP"),
        F.when(t.every("vec_id", 9), F.lit(t.NAN))
        .otherwise(_milli(F.get("embedding", F.lit(0))).cast("double"))
        .alias("GR"),
        F.concat(F.lit("note "), F.col("vec_id").cast("string")).alias("NOTE"),
        "embedding",
    )
    entries = [
        ("TDEP", "TDEP", "0.1 in", "depth"), ("GR", "GR", "gAPI", "gamma"), ("NOTE", "note", "", ""),
        ("embedding", "IMG", "", "image"),
    ]
    facts = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"), F.lit(name).alias("name"), F.lit(units).alias("units"),
                F.lit(long_name).alias("long_name"), F.lit(f"T.CHANNEL-I.{name}").alias("fingerprint"),
            )
            for field, name, units, long_name in entries
        ]
    )
    metadata = frame.select(*DATASET_KEYS).distinct().select(
        *DATASET_KEYS,
        F.explode(facts).alias("fact"),
        F.col("dataset_id").alias("frame_name"),
        F.concat(F.lit("object-"), "dataset_id").alias("frame_object_id"),
        F.lit("BOREHOLE-DEPTH").alias("index_type"),
        F.lit("Well F").alias("well_name"),
    ).select("*", "fact.*").drop("fact")
    return frame, metadata


@query(
    """SELECT 'frames' AS document_id, 'frame-' || "label" AS dataset_id, c.channel_id, c.minimum, c.maximum,
  c.sample_count, c.null_count, c.storage_kind, c.data_type FROM (
  SELECT "label", unnest([
    {'channel_id': 'curve-frame-' || "label" || '-1-gr',
      'minimum': (min(round(embedding[1] * 1000)::INT) FILTER (WHERE vec_id % 9 > 0))::DOUBLE,
      'maximum': (max(round(embedding[1] * 1000)::INT) FILTER (WHERE vec_id % 9 > 0))::DOUBLE,
      'sample_count': count(*), 'null_count': count(*) FILTER (WHERE vec_id % 9 = 0), 'storage_kind': 'parquet',
      'data_type': 'numeric'},
    {'channel_id': 'curve-frame-' || "label" || '-2-note', 'minimum': NULL, 'maximum': NULL,
      'sample_count': count(*), 'null_count': 0, 'storage_kind': 'parquet', 'data_type': 'text'},
    {'channel_id': 'curve-frame-' || "label" || '-3-img', 'minimum': min(list_min(embedding))::DOUBLE,
      'maximum': max(list_max(embedding))::DOUBLE, 'sample_count': count(*), 'null_count': 0,
      'storage_kind': 'zarr', 'data_type': 'numeric'}]) AS c
  FROM embeddings GROUP BY "label")"""
)
def frame_channels(spark: SparkSession, folder: str) -> DataFrame:
    frame, metadata = _frame(spark, folder)
    tables, _ = ingest_frames(frame, ["TDEP", "GR", "NOTE", "embedding"], metadata)
    return tables.channels.select(
        *DATASET_KEYS, "channel_id", "minimum", "maximum", "sample_count", "null_count", "storage_kind",
        "data_type",
    )


@query(
    """SELECT 'frames' AS document_id, 'frame-' || "label" AS dataset_id,
  'curve-frame-' || "label" || '-1-gr' AS channel_id, vec_id AS ordinal, vec_id * 0.5::DOUBLE AS "index",
  CASE WHEN vec_id % 9 > 0 THEN round(embedding[1] * 1000)::INT::DOUBLE END AS value, NULL::VARCHAR AS text_value
FROM embeddings
UNION ALL SELECT 'frames', 'frame-' || "label", 'curve-frame-' || "label" || '-2-note', vec_id, vec_id * 0.5::DOUBLE,
  NULL, 'note ' || vec_id FROM embeddings"""
)
def frame_samples(spark: SparkSession, folder: str) -> DataFrame:
    frame, metadata = _frame(spark, folder)
    tables, _ = ingest_frames(frame, ["TDEP", "GR", "NOTE", "embedding"], metadata)
    return tables.samples


@query(
    """SELECT 'arrays' AS document_id, 'label-' || "label" AS dataset_id, 'image' AS mnemonic, count(*) AS sample_count,
  min(list_min(embedding))::DOUBLE AS minimum, max(list_max(embedding))::DOUBLE AS maximum,
  0::BIGINT AS null_count, max(len(embedding))::INT AS dimension FROM embeddings GROUP BY "label\""""
)
def array_collection(spark: SparkSession, folder: str) -> DataFrame:
    arrays = t.table(spark, folder, "embeddings").select(
        F.lit("arrays").alias("document_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("dataset_id"),
        F.lit(0).alias("position"),
        F.lit("image").alias("name"),
        F.lit("").alias("unit"),
        F.col("vec_id").alias("ordinal"),
        F.array(F.size("embedding")).alias("shape"),
        F.transform("embedding", lambda item: item.cast("double")).alias("values"),
    )
    tables = ingest_array_collection(arrays, "Well A")
    return tables.channels.select(
        *DATASET_KEYS, "mnemonic", "sample_count", "minimum", "maximum", "null_count",
        F.get("sample_shape", F.lit(0)).alias("dimension"),
    )


