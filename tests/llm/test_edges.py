"""Nulls, empty tables, repeated rows and clashing columns: operators and the whole chain."""

import sys
from pathlib import Path

import pytest
from helpers import awkward_texts, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from curveframe.llm import decontaminate, license_scan, packing, quality, secret_scan  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CLASHING = "p_quality double, p_civil double, n_words string, kept string, hit_items string, shard int, ids binary, in_0 string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
ITEMS = "item_id bigint, text string"


def documents(spark):
    """The table with columns named as operators name theirs, awkward texts, nulls and repeated rows."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    extra = (0.5, None, "seven", "yes", None, 3, b"\x01", None)
    rows = [(*row, *extra) for row in given]
    rows += [(10_000 + at, text, None, None, None, *extra) for at, text in enumerate(awkward_texts())]
    rows += rows[:5] + [(None, prose(80, 9), None, None, None, *extra), (None, None, None, None, None, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


def folder_with(path, docs, labels, benchmark):
    for name, frame in dict(documents=docs, labels=labels, benchmark=benchmark).items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_chain_on_awkward_rows(spark, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = [(None, 1, 0), (3, None, None), (3, 1, None), (99_999, 0, 1)]
    kinds = labels.select("doc_id", "quality", "toxic")
    labels = kinds.unionAll(spark.createDataFrame(odd, "doc_id bigint, quality int, toxic int"))
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text")
    items = items.unionAll(spark.createDataFrame([(None, None), (None, "")], ITEMS))
    folder = folder_with(tmp_path, documents(spark), labels, items)
    held = spark.read.parquet(f"{folder}/documents.parquet")
    before = {tuple(row) for row in held.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        held = function(spark, held, folder).cache()
        assert held.dtypes == spark.createDataFrame([], SCHEMA).dtypes, name
        now = {tuple(row) for row in held.collect()}
        assert now and now <= before, name
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, folder).collect()
    assert {row["doc_id"] for row in pieces} == {row[0] for row in before}


def test_chain_on_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    folder = folder_with(tmp_path, spark.createDataFrame([], SCHEMA), labels, spark.createDataFrame([], ITEMS))
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        held = function(spark, held, folder)
        assert held.columns == spark.createDataFrame([], SCHEMA).columns and held.collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_classifier_without_reviews_keeps_rows_apart(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.score(docs, none).count() == docs.count()


def test_packing_of_repeated_rows_and_rows_without_id(spark):
    docs = documents(spark)
    pieces = packing.pack(docs).collect()
    texts = docs.count()
    assert sum(row["start"] == 0 for row in pieces) == texts
    whole = {}
    for row in pieces:
        whole.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in whole.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW


def test_scans_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "what is the capital of france")], ITEMS)
    assert decontaminate.annotate(docs, items).collect() == []
    ledger = secret_scan.scan(docs, secret_scan.empty_ledger(spark))
    assert ledger.collect() == [] and secret_scan.findings(docs, ledger).collect() == []


@pytest.mark.parametrize("names", [("license_id", "block", "unit", "pairs"), ("LINES", "at", "one", "start")])
def test_licences_beside_clashing_columns_and_repeated_rows(spark, names):
    notice = "head\nReleased under the MIT License.\n"
    columns = ", ".join(f"{name} string" for name in names)
    docs = spark.createDataFrame([(at, notice, *names) for at in (1, 1, None)], f"doc_id bigint, text string, {columns}")
    found = license_scan.findings(docs).collect()
    assert sorted((row["doc_id"] or 0, row["license_id"], row["unit_no"]) for row in found) == [(0, "MIT", 1)] + [(1, "MIT", 1)] * 2
