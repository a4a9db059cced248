"""Nearest rows against a sort of all rows, on indexes that defeat even buckets."""

import math
import random

import pytest

from curveframe.operators import cursor
from curveframe.operators.asof import nearest

ROWS = "document_id string, dataset_id string, ordinal bigint, index double, value double"
CURSORS = "document_id string, dataset_id string, query double"


def datasets():
    source = random.Random(4)
    yield "outlier", [*[source.random() for _ in range(300)], 1e300, -1e300]
    yield "ties", [5.0] * 400 + [6.0] * 3 + [4.0] * 40
    yield "holes", [source.choice([None, math.nan, math.inf, -math.inf, 1.0, 2.0, 3.0]) for _ in range(300)]
    yield "falling", [1000.0 - at for at in range(700)]
    yield "one", [3.0]
    yield "blank", [None, None]


def rows_and_cursors():
    source = random.Random(7)
    rows, cursors = [], []
    for name, indexes in datasets():
        rows += [("d", name, at, index, None if at % 3 else float(at)) for at, index in enumerate(indexes)]
        known = [index for index in indexes if index is not None and math.isfinite(index)] or [0.0]
        places = [*source.choices(known, k=15), *[source.uniform(-2, 1100) for _ in range(15)], 5.0, 5.0, -1e6]
        cursors += [("d", name, place) for place in places]
    return rows, [*cursors, ("d", "absent", 1.0), ("d", "one", None), ("d", "one", math.nan)]


def distance(index, query):
    gap = abs(index - query)
    return (math.isnan(gap), gap)


@pytest.mark.parametrize("count", [1, 3, 32])
def test_nearest_rows(spark, count):
    rows, cursors = rows_and_cursors()
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    found = {}
    for row in nearest(frame, spark.createDataFrame(cursors, CURSORS), count).collect():
        found.setdefault((row["dataset_id"], row["query"]), []).append((row["place"], row["ordinal"]))
    wanted = {}
    for _, name, query in cursors:
        if query is None or math.isnan(query):
            continue
        known = [row for row in rows if row[1] == name and row[3] is not None]
        best = sorted(known, key=lambda row: (distance(row[3], query), row[2]))[:count]
        if best:
            wanted[name, query] = [(place, row[2]) for place, row in enumerate(best, 1)]
    assert {key: sorted(places) for key, places in found.items()} == wanted


def test_nearest_values(spark):
    rows, cursors = rows_and_cursors()
    samples = [(*row[:2], "c", *row[2:]) for row in rows] + [(*row[:2], "all", *row[2:4], 1.0) for row in rows]
    frame = spark.createDataFrame(samples, "document_id string, dataset_id string, channel_id string, ordinal bigint, index double, value double")
    points = spark.createDataFrame(cursors, CURSORS)
    found = {(r["dataset_id"], r["channel_id"], r["query"]): (r["index"], r["value"]) for r in cursor.nearest_values(frame, points).collect()}
    for (name, channel, query), (index, value) in found.items():
        known = [row for row in samples if row[1:3] == (name, channel) and row[4] is not None and row[5] is not None]
        best = min(known, key=lambda row: (distance(row[4], query), row[3]))
        assert str((index, value)) == str((best[4], best[5]))
    # Every finite cursor of a dataset that has an index, for both curves: 31 to 33 distinct ones each.
    usable = {(name, query) for _, name, query in cursors if query is not None and not math.isnan(query)}
    assert len(found) == 2 * len([key for key in usable if key[0] not in ("absent", "blank")])


def test_one_cursor_in_one_large_dataset(spark):
    large = spark.range(300_000).selectExpr("'d' AS document_id", "'hot' AS dataset_id", "id AS ordinal", "double(id % 1000) AS index")
    points = spark.createDataFrame([("d", "hot", 500.2)], CURSORS)
    found = nearest(large, points, 32).orderBy("place").collect()
    assert [row["ordinal"] for row in found] == [500 + 1000 * at for at in range(32)]


def test_more_places_than_rows(spark):
    """Places that no row takes are not written out, however many are asked for."""
    rows = [("d", "few", at, float(at), None) for at in range(3)]
    marks = spark.createDataFrame([("d", "few", 0.4), ("d", "few", 9.0), ("d", "none", 1.0)], CURSORS)
    found = nearest(spark.createDataFrame(rows, ROWS), marks, 1 << 31).collect()
    assert set(found[0].__fields__) == {"document_id", "dataset_id", "query", "ordinal", "index", "place"}
    assert sorted((row["query"], row["place"], row["ordinal"]) for row in found) == [
        (0.4, 1, 0), (0.4, 2, 1), (0.4, 3, 2), (9.0, 1, 2), (9.0, 2, 1), (9.0, 3, 0)
    ]
