"""Registered corpus queries against their SQL twins, and the pipeline's stages."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from curveframe.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def ordered(columns, rows):
    places = [columns.index(name) for name in sorted(columns)]
    return sorted(tuple(str(row[place]) for place in places) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    frame = queries.QUERIES[name](spark, FOLDER)
    answer = duck.execute(queries.ORACLES[name])
    columns = [item[0] for item in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ordered(frame.columns, frame.collect()) == ordered(columns, answer.fetchall())


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{number}" for number in range(1, 14)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held, kept = docs, []
    for _, function in corpus_pipeline.STAGES[:-1]:
        held = function(spark, held, FOLDER).cache()
        assert held.columns == docs.columns
        kept.append({row["doc_id"] for row in held.select("doc_id").collect()})
    assert all(later <= earlier for earlier, later in zip(kept, kept[1:], strict=False))
    junk = {row["doc_id"] for row in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    assert len(junk & kept[0]) <= 0.1 * len(junk)
    texts = [row["text"] for row in held.select("text").collect()]
    assert len(texts) == len(set(texts))
    packed = {row["doc_id"] for row in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()}
    assert packed == kept[-1]
