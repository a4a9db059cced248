"""Deep pages, even rows, versioned settings and files beyond one row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from curveframe.operators import catalog, stats
from curveframe.operators.paging import SortedPages
from curveframe.sources import registry, sinks


def test_deep_pages_equal_a_sort(spark):
    rows = [(f"d{min(at % 7, 2)}", f"t{at % 3}", f"n{at * 7919 % 1000:04d}", f"i{at:05d}", None, None) for at in range(3000)]
    objects = spark.createDataFrame(rows, "document_id string, object_type string, name string, id string, native_id string, parent_native_id string")
    ordered = {}
    for row in sorted(rows, key=lambda row: row[1:4]):
        ordered.setdefault(row[0], []).append(row[3])
    pages = SortedPages(objects, ["document_id"], catalog.OBJECT_ORDER, ranges=16)
    for start, end in ((0, 10), (395, 460), (1990, 2200), (5000, 5010)):
        found = pages.page(start, end).orderBy("document_id", "place").collect()
        wanted = [(name, start + at + 1, len(ids), key) for name, ids in sorted(ordered.items()) for at, key in enumerate(ids[start:end])]
        assert [(r.document_id, r.place, r.total, r.id) for r in found] == wanted
    everything = [row[3] for row in sorted(rows, key=lambda row: row[1:4])]
    assert [r.id for r in catalog.object_page(objects, 21, 100).collect()] == everything[2100:2200]
    shallow = catalog.object_pages_by_document(objects, 1, 30).collect()
    deep = pages.page(30, 60).select(shallow[0].__fields__).collect()
    assert sorted(shallow) == sorted(deep)


@pytest.mark.parametrize("points", [1, 2, 7, 100, 1000])
def test_even_rows_of_dense_and_sparse_axes(spark, points):
    sizes = {"a": 1, "b": 2, "c": 333, "d": 1000}
    dense = [("x", name, at, float(at)) for name, size in sizes.items() for at in range(size)]
    axis = spark.createDataFrame(dense, "document_id string, dataset_id string, ordinal bigint, index double")
    sparse = axis.withColumn("ordinal", F.col("ordinal") * 3 + 5)
    found = {(r.dataset_id, r.position) for r in stats.even_rows(axis, points, dense=True).collect()}
    numbered = stats.even_rows(sparse, points, chunk_rows=64).collect()
    assert {(r.dataset_id, r.position) for r in numbered} == found
    assert all(r.ordinal == 3 * r.position + 5 for r in numbered)
    for name, size in sizes.items():
        step = (size - 1) / max(points - 1, 1)
        wanted = set(range(size)) if size <= points else {int(k * step) for k in range(points - 1)} | ({size - 1} if points > 1 else {0})
        assert {at for key, at in found if key == name} == wanted


SETTINGS = "document_id string, dataset_id string, time_display_mode string, time_zone string, version bigint"


def test_settings_log(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    sinks.append_settings(spark.createDataFrame([("d", "a", "elapsed", "utc", 0), ("d", "b", "elapsed", "utc", 0)], SETTINGS), folder)
    sinks.append_settings(spark.createDataFrame([("d", "a", "clock", "utc", 1), ("d", "a", "clock", "local", 1), ("d", "a", "elapsed", "utc", 1)], SETTINGS), folder)
    newest = sorted(map(tuple, sinks.read_settings(spark, folder).collect()))
    # Of three at one version, the one that sorts last.
    assert newest == [("d", "a", "elapsed", "utc", 1), ("d", "b", "elapsed", "utc", 0)]
    compact = str(tmp_path / "compact")
    sinks.compact_settings(spark, folder, compact)
    assert spark.read.parquet(f"{compact}/settings_log").count() == 2
    assert sorted(map(tuple, sinks.read_settings(spark, compact).select(sinks.read_settings(spark, folder).columns).collect())) == newest


def test_checksums_of_files_of_any_size(spark, tmp_path):
    contents = {"one.las": b"1", "a b.las": b"x" * 10, "c.dat": bytes(range(256)) * 20_000}
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    wanted = {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in contents.items()}
    for whole_bytes in (0, 100, registry.WHOLE_BYTES):
        found = registry.read_registry(spark, str(tmp_path), whole_bytes=whole_bytes).collect()
        assert {r.file_name: (r.file_size_bytes, r.sha256) for r in found} == wanted


def test_checksum_beyond_a_row(spark, tmp_path):
    size = (1 << 31) + 12345
    with open(tmp_path / "large.dlis", "wb") as file:
        file.truncate(size)  # a hole: takes no disk
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & ((1 << 20) - 1)))
    row = registry.read_registry(spark, str(tmp_path)).first()
    assert (row.file_size_bytes, row.sha256, row.source_format) == (size, digest.hexdigest(), "DLIS")
