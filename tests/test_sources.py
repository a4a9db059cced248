import math
from pathlib import Path

from pyspark.sql import functions as F

from curveframe.operators import assets, catalog, pages
from curveframe.sources import las, registry, sinks, witsml
from curveframe.sources.frames import ingest_array_collection, ingest_frames

NUMERIC_TIME = """~Version block
 VERS. 2.0 : two
~Well block
 NULL. -1 : missing
 WELL. Kestrel 12 : hole
~Curve block
 ETIME.min : minutes since start
 FLOW.L/S : rate
~Ascii block
 0.5 3.25
 1 3.5
 1 3.5
 -1 9
 4 -1
 6.5 8
"""
DATE_TIME = """~Version
VERS. 1.2 : old layout
~Well
STRT.S 1 : first
NULL. -9 : sentinel
WELL. WELL : Bravo 7
SRVC. COMPANY : http://logs.example/a
DATE. LOG DATE : 12:30:45
~Curve
BIT.M : bit depth
TIME.HHMMSS :
RPM.1/MIN :
DATE.D :
NOTE. :
~Ascii
100.5 06:15:00 60 29-Feb-24 1.5d
101.5 06:15:30 -9 29-Feb-24 7
99.0 23:59:59 62 29-Feb-24 8
-9 00:00:29 63 01-Mar-24 9
102.25 12:00:00 64 01-Mar-24 9
"""
TWO_INDEXES = """~V
VERS. 2.0 :
DLM. COMMA :
~W
NULL. -1 :
~C
DEPT.M :
TVD.M :
GR.GAPI : gamma
# comment
~A
1, 2, 5
2, 3, -1
3, 4, text
"""


def test_numeric_elapsed_time(raw):
    tables = las.ingest_las(raw(("t", "t.las", NUMERIC_TIME)))
    dataset = tables.datasets.first()
    assert (dataset.index_unit, dataset.index_minimum, dataset.index_maximum) == ("s", 30.0, 390.0)
    assert '"time_index_reference":"elapsed"' in dataset.native_metadata
    assert '"ETIME":"source_etime"' in dataset.native_metadata and dataset.row_count == 6
    assert [r.value for r in tables.samples.orderBy("ordinal").collect()] == [3.25, 3.5, 3.5, 9.0, None, 8.0]
    axis = tables.axis.orderBy("ordinal").collect()
    assert [str(r["index"]) for r in axis] == ["30.0", "60.0", "60.0", "nan", "240.0", "390.0"]
    assert [r.index_source["value"] for r in axis] == ["0.5", "1", "1", "-1", "4", "6.5"]


def test_date_and_time_pair(raw):
    tables = las.ingest_las(raw(("d", "d.las", DATE_TIME)))
    dataset = tables.datasets.first()
    assert (dataset.index_kind, dataset.index_mnemonic, dataset.index_unit) == ("time", "TIME", "s")
    assert dataset.well_name == "Bravo 7" and dataset.row_count == 5
    index = [r["index"] for r in tables.axis.orderBy("ordinal").collect()]
    midnight = 1709251200.0
    assert index == [midnight - 63900, midnight - 63870, midnight - 1, midnight + 29, midnight + 43200]
    channels = {r.mnemonic: r for r in tables.channels.collect()}
    assert set(channels) == {"BIT", "RPM", "NOTE"}
    assert channels["BIT"].null_count == 1 and channels["RPM"].null_count == 1
    assert channels["BIT"].description == "bit depth" and channels["RPM"].description == "Imported LAS curve"
    assert channels["NOTE"].data_type == "text"
    assert "UTC was assumed" in tables.warnings.first().message
    assert tables.status.first().status == "OK"


def test_header_lines(raw):
    lines = """~Version
VERS. 2.0 : CWLS
~Well
FLD. Unit: 4 : field : name
SRVC. http://x.example/a : service
URL. http://x.example/b
DATE. 12:30:45
RUN. 3 at 08:15 : begun 07:45
NONE.M :
~Curve
DEPT.M : depth
GR.GAPI : gamma  ray
~A
1 2
"""
    parsed = las.parse_las(raw(("h", "h.las", lines))).first()
    found = {item.mnemonic: (item.unit, item.value, item.description) for item in parsed.well_items}
    assert found == {
        "FLD": ("", "Unit: 4 : field", "name"),
        "SRVC": ("", "http://x.example/a", "service"),
        "URL": ("", "http://x.example/b", ""),
        "DATE": ("", "12:30:45", ""),
        "RUN": ("", "3 at 08:15", "begun 07:45"),
        "NONE": ("M", "", ""),
    }
    assert [item.description for item in parsed.curve_items] == ["depth", "gamma  ray"]


def test_ambiguous_index_waits_for_a_choice(spark, raw):
    documents = raw(("two", "two.las", TWO_INDEXES), ("no", "no.txt", "x"), ("bad", "bad.las", "~V\n"))
    waiting = las.ingest_las(documents)
    status = {r.document_id: (r.status, r.message) for r in waiting.status.collect()}
    assert status["two"][0] == "INDEX_SELECTION_REQUIRED"
    assert status["no"] == ("FAILED", las.NOT_LAS) and status["bad"] == ("FAILED", las.NO_CURVES)
    candidates = [r.mnemonic for r in waiting.candidates.orderBy("source_position").collect()]
    assert candidates == ["DEPT", "TVD"] and waiting.datasets.count() == 0
    choice = spark.createDataFrame(
        [("two", "dataset-las-two", "curve:1")], "document_id string, dataset_id string, candidate_id string"
    )
    tables = las.ingest_las(documents, choice)
    dataset = tables.datasets.first()
    assert (dataset.index_mnemonic, dataset.index_kind) == ("TVD", "true_vertical_depth")
    channels = tables.channels.orderBy("position").collect()
    assert [c.mnemonic for c in channels] == ["DEPT", "GR"]
    assert [c.data_type for c in channels] == ["numeric", "text"]
    preview = las.ingest_las(documents, take_first=True)
    assert preview.datasets.first().index_mnemonic == "DEPT"
    unknown = las.ingest_las(documents, choice.withColumn("candidate_id", F.lit("curve:9")))
    assert {r.document_id: r.message for r in unknown.status.collect()}["two"] == las.UNKNOWN_CHOICE


V21 = """<?xml version="1.0"?>
<Log xmlns="http://www.energistics.org/energyml/data/witsmlv2" schemaVersion="2.1" uuid="m-77">
  <Citation><Title>Mud log</Title></Citation>
  <ChannelSet>
    <Citation><Title>Surface sensors</Title></Citation>
    <Index><Mnemonic>CLOCK</Mnemonic><IndexType>Time</IndexType><Uom>s</Uom></Index>
    <Channel><Mnemonic>SPECTRUM</Mnemonic><Uom>unitless</Uom></Channel>
    <Channel><Mnemonic>ROP</Mnemonic><Uom>m/h</Uom></Channel>
    <Data><Data><![CDATA[
      [[["2024-05-31T23:59:58.500Z"], [[[[[1, 2, 3]], [[4, 5, 6]]]], 12.5]],
       [["2024-06-01T00:00:00Z"], [[[[[7, 8, 9]], [[-1, 0, 2]]]], "7f"]],
       {"not": "a row"},
       [["2024-06-01T00:00:01Z"], [[[[[1, 1, 1]], [[1, 1, 1]]]], 14]]]
    ]]></Data></Data>
  </ChannelSet>
</Log>"""


def test_channel_set_with_scalar_and_array(raw):
    documents = witsml.read_documents(raw(("v", "v.xml", V21), ("x", "x.xml", "<a>"), ("h", "h.xml", "<a/>")))
    rows = {r.document_id: r for r in documents.collect()}
    assert rows["v"].version == "2.1" and rows["v"].problem is None
    messages = {r.document_id: r.message for r in witsml.document_warnings(documents).collect()}
    assert messages == {"x": "Could not parse x.xml", "h": "h.xml is not a recognized WITSML XML document."}
    tables = witsml.ingest_channel_sets(documents)
    dataset = tables.datasets.first()
    assert (dataset.index_kind, dataset.index_mnemonic, dataset.row_count) == ("time", "CLOCK", 3)
    channels = tables.channels.orderBy("position").collect()
    assert [c.storage_kind for c in channels] == ["zarr", "parquet"]
    assert [c.sample_shape for c in channels] == [[1, 2, 1, 3], []]
    assert (channels[0].minimum, channels[0].maximum) == (-1.0, 9.0)
    samples = tables.samples.orderBy("ordinal").collect()
    clock = 1717200000.0
    assert [s["index"] for s in samples] == [clock - 1.5, clock, clock + 1]
    assert [s.text_value or s.value for s in samples] == [12.5, "7f", 14.0]
    objects = witsml.ingest_objects(documents)
    found = objects.objects.first()
    assert (found.object_type, found.native_id, found.name) == ("Log", "m-77", "Mud log")
    assert "2024-06-01" not in found.payload
    source = witsml.source_rows(documents, objects.well_names).first()
    assert source.source_version == "2.1"


TRAJECTORY = """<trajectorys xmlns="http://www.witsml.org/schemas/1series">
<trajectory uidWell="w" uidWellbore="b" uid="t"><nameWell>Well T</nameWell><name>path</name>
<trajectoryStation><md uom="m">0</md><incl uom="rad">0.1</incl><azi>x</azi></trajectoryStation>
<trajectoryStation><md uom="m">10</md><incl uom="rad"/><azi/></trajectoryStation>
</trajectory></trajectorys>"""


def test_trajectory(raw):
    documents = witsml.read_documents(raw(("t", "t.xml", TRAJECTORY)))
    tables = witsml.ingest_trajectories(documents)
    assert [c.mnemonic for c in tables.channels.collect()] == ["INCL"]
    channel = tables.channels.first()
    assert (channel.unit, channel.null_count, channel.minimum) == ("rad", 1, 0.1)
    dataset = tables.datasets.first()
    assert (dataset.kind, dataset.index_mnemonic, dataset.index_maximum) == ("trajectory", "MD", 10.0)
    objects = witsml.ingest_objects(documents)
    assert objects.objects.first().parent_native_id == "b"
    assert [(r.target_native_id, r.relationship_type) for r in objects.relationships.collect()] == [("b", "parent")]


def test_frames(spark):
    frame = spark.createDataFrame(
        [("d", "f", 0, "a", 1.0, [[1.0, 2.0], [3.0, 4.0]]), ("d", "f", 1, "b", math.nan, [[5.0, math.nan], [7.0, 8.0]])],
        "document_id string, dataset_id string, ordinal bigint, IDX string, GR double, IMG array<array<double>>",
    )
    metadata = spark.createDataFrame(
        [("d", "f", name, name, "", "", f"fp-{name}", "obj", "frame", "", "W") for name in ("IDX", "GR", "IMG")],
        "document_id string, dataset_id string, field string, name string, units string, long_name string, "
        "fingerprint string, frame_object_id string, frame_name string, index_type string, well_name string",
    )
    tables, edges = ingest_frames(frame, ["IDX", "GR", "IMG"], metadata)
    assert [r["index"] for r in tables.axis.orderBy("ordinal").collect()] == [0.0, 1.0]
    channels = {r.mnemonic: r for r in tables.channels.collect()}
    assert channels["GR"].null_count == 1 and channels["IMG"].sample_shape == [2, 2]
    assert channels["IMG"].null_count == 1 and channels["IMG"].maximum == 8.0
    assert tables.datasets.first().index_kind == "sample"
    assert {r.target_native_id for r in edges.collect()} == {"fp-GR", "fp-IMG"}


def test_array_collection(spark):
    arrays = spark.createDataFrame(
        [("d", "h", 0, "image", "", 0, [3], [0.0, 1.0, 2.0]), ("d", "h", 0, "image", "", 1, [3], [3.0, 4.0, math.nan])],
        "document_id string, dataset_id string, position int, name string, unit string, ordinal bigint, "
        "shape array<int>, values array<double>",
    )
    tables = ingest_array_collection(arrays, "Array well", "arrays.parquet")
    dataset, channel = tables.datasets.first(), tables.channels.first()
    assert (dataset.kind, dataset.row_count, dataset.index_maximum) == ("array_collection", 2, 1.0)
    assert (channel.sample_shape, channel.null_count, channel.sample_count) == ([3], 1, 2)


def test_files_catalog_and_csv(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b.las").write_text(DATE_TIME)
    (folder / "note.txt").write_text("x")
    listed = registry.read_registry(spark, str(folder))
    assert {r.file_name: r.source_format for r in listed.collect()} == {"a b.las": "LAS", "note.txt": None}
    assert registry.unsupported_files(listed).count() == 1
    tables = las.ingest_las(registry.read_text_documents(spark, str(folder), "*.las"))
    out = str(tmp_path / "catalog")
    sources = tables.sources.join(listed.select("document_id", "sha256"), "document_id", "left")
    sinks.write_catalog(
        {
            "sources": sources,
            "datasets": tables.datasets,
            "channels": tables.channels,
            "preview_samples": tables.preview_samples,
            "preserved_objects": tables.preserved_objects,
            "view_settings": catalog.default_settings(tables.datasets),
            "warnings": tables.warnings,
        },
        out,
    )
    stored = sinks.read_catalog(spark, out)
    assert stored["sources"].first().file_name == "a b.las" and stored["sources"].first().sha256
    document, dataset = stored["datasets"].select("document_id", "dataset_id").first()
    tree = catalog.document_trees(
        stored["datasets"], stored["channels"], stored["preview_samples"], stored["view_settings"], [document]
    ).first()
    assert [c.mnemonic for c in tree.curves] == ["BIT", "RPM", "NOTE"] and len(tree.curves[1].preview_samples) == 5
    assert tree.time_display_mode == "clock" and tree.scalar_curve_count == 3

    samples_path = str(tmp_path / "samples")
    sinks.write_samples(tables.samples, samples_path, partitions=2)
    samples = sinks.read_samples(spark, samples_path)
    curves = [r.channel_id for r in stored["channels"].orderBy("position").collect()]
    assert sinks.scan_channels(samples, document, dataset, curves[:1]).count() == 5
    page = pages.sample_page(samples, tables.axis, curves[1::-1], 2, 2)
    assert page.columns[2:] == ["__index", "curve-2-rpm", "curve-0-bit"]
    assert page.collect()[0]["curve-2-rpm"] == 64.0

    destination = tmp_path / "csv"
    header = pages.export_csv(
        tables.axis, samples, stored["channels"], document, dataset, "TIME", str(destination)
    )
    assert header == ["TIME", "BIT", "RPM"]
    text = "".join(part.read_bytes().decode() for part in sorted(Path(destination).glob("part-*")))
    lines = text.split("\r\n")
    assert lines[0] == "TIME,BIT,RPM" and len(lines) == 7 and lines[2].split(",")[2] == ""

    files = registry.read_package_files(spark, samples_path, "doc")
    manifest = assets.build_manifest(files)
    assert assets.verify_assets(manifest, manifest.drop("kind")).count() == 0
    bad = manifest.drop("kind").withColumn("size_bytes", F.col("size_bytes") + 1)
    errors = [r.error for r in assets.verify_assets(manifest, bad).collect()]
    assert errors and all("size mismatch" in error for error in errors)


def test_unsafe_and_old_packages(spark):
    manifest = spark.createDataFrame([("d", "../outside.txt", "metadata", 1, "x")], "document_id string, path string, kind string, size_bytes bigint, sha256 string")
    packages = spark.createDataFrame([("d", "0.9")], "document_id string, package_version string")
    errors = assets.verify_assets(manifest, manifest.drop("kind"), packages)
    texts = sorted(r.error for r in errors.collect())
    assert texts == ["Unsafe or duplicate member: ../outside.txt", "package version 0.9 is not supported"]
    assert assets.verification(manifest, errors).first().valid is False


def test_header_names():
    assert pages.header_names(["GR", "GR", "gr", "GR"]) == ["GR", "GR_2", "gr", "GR_3"]


QUOTED = """<?xml version="1.0"?>
<logs note='a > b "c"' xmlns="http://www.witsml.org/schemas/1series" version="1.4.1.1">
<log uid="x > y"><name>first</name><logData note="<1>1"><mnemonicList>MD,GR</mnemonicList><data>1,10</data><data>2</data></logData></log>
<log uid="none"><name>second</name><logData><mnemonicList/><data>1,10</data></logData></log>
<log uid="rows"><logData><mnemonicList>MD,GR</mnemonicList></logData></log>
</logs>""".replace("<1>1", "1>1")


def test_logs_that_cannot_be_read(raw):
    documents = witsml.read_documents(raw(("q", "q.xml", QUOTED)))
    assert documents.first().version == "1.4.1.1" and documents.first().problem is None
    tables = witsml.ingest_column_logs(documents)
    assert [(s["index"], s.value) for s in tables.samples.orderBy("ordinal").collect()] == [(1.0, 10.0), (2.0, None)]
    assert tables.datasets.count() == 1
    warnings = [(r.ordinal, r.message) for r in witsml.log_warnings(documents).orderBy("ordinal").collect()]
    assert warnings == [
        (0, "WITSML log second could not be normalized: " + witsml.NO_MNEMONICS),
        (1, "WITSML log rows could not be normalized: " + witsml.NO_ROWS),
    ]
    objects = witsml.ingest_objects(documents).objects.orderBy("id").collect()
    assert [o.native_id for o in objects] == ["x > y", "none", "rows"]
    assert all("<data>" not in o.payload for o in objects)


def test_samples_stay_beside_their_index(raw):
    documents = witsml.read_documents(raw(("v", "v.xml", V21), ("q", "q.xml", QUOTED), ("t", "t.xml", TRAJECTORY)))
    for tables in (witsml.ingest_column_logs(documents), witsml.ingest_channel_sets(documents), witsml.ingest_trajectories(documents)):
        for frame in (tables.samples, tables.array_samples, tables.axis):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_running_sums(spark):
    from curveframe.functions.arrays import running_sums

    data = [[], [5], list(range(-300, 700)), [1] * 256, [2] * 257]
    frame = spark.createDataFrame([(at, values) for at, values in enumerate(data)], "id int, numbers array<int>")
    for row in frame.select("numbers", running_sums(F.col("numbers")).alias("sums")).collect():
        assert row.sums == [sum(row.numbers[: at + 1]) for at in range(len(row.numbers))]
