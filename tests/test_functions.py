import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveframe.functions import numeric, text, timeindex
from curveframe.operators.stats import even_positions


def value_of(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given,expected",
    [("1.5", 1.5), (" 2 ", 2.0), ("inf", None), ("NaN", None), ("abc", None), (None, None)],
)
def test_finite_number(spark, given, expected):
    assert value_of(spark, numeric.finite_number(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(
    "given,expected", [("Gamma Ray (API)", "gamma-ray-api"), ("--", "item"), ("", "item"), ("a_b", "a-b")]
)
def test_slug(spark, given, expected):
    assert value_of(spark, text.slug(F.lit(given))) == expected


@pytest.mark.parametrize("given", [0.2025, 0.5, 0.2035, 1.0, 1 / 3, 0.20625])
def test_percent_rounds_like_python(spark, given):
    assert value_of(spark, numeric.percent_text(F.lit(given))) == f"{given:.1%}"


@pytest.mark.parametrize(
    "date,time,expected",
    [
        ("24-Mar-09", "23:59:50", 1237939190.0),
        ("24-MAR-2009", "23:59:50.25", 1237939190.25),
        ("2009-03-24", "23:59:50", 1237939190.0),
        ("01-Jan-72", "00:00:00", 63072000.0),
        ("01-Jan-68", "00:00:00", 3092601600.0),
        ("32-Jan-09", "00:00:00", None),
    ],
)
def test_date_time_epoch(spark, date, time, expected):
    assert value_of(spark, timeindex.date_time_epoch(F.lit(date), F.lit(time))) == expected


@pytest.mark.parametrize(
    "given,expected",
    [(0, "00:00:00"), (3661.4, "01:01:01"), (90061, "1d 01:01:01"), (-60, "−00:01:00"), (0.5, "00:00:01")],
)
def test_elapsed_label(spark, given, expected):
    assert value_of(spark, timeindex.elapsed_label(F.lit(float(given)))) == expected


@pytest.mark.parametrize("term,hit", [("amm", True), ("A%R", True), ("r%g", False), ("G_MMA", True), ("%", True), ("a\\", False)])
def test_like_anywhere(spark, term, hit):
    assert value_of(spark, text.like_anywhere(term, F.lit("Gamma Ray"))) is hit


def test_even_positions_match_linspace(spark):
    for rows in (1, 2, 7, 50, 101, 997, 5000):
        for points in (1, 2, 10, 23, 100, 800):
            kept = (
                spark.range(rows)
                .where(even_positions(F.col("id"), F.lit(rows), points))
                .collect()
            )
            if rows <= points:
                expected = list(range(rows))
            else:
                expected = sorted(set(np.linspace(0, rows - 1, num=points, dtype=np.int64).tolist()))
            assert sorted(row.id for row in kept) == expected, (rows, points)


def test_clock_prefers_manual_anchor(spark):
    anchored = timeindex.clock_seconds(F.lit(10.0), F.lit("absolute_utc"), F.lit(5.0), F.lit(100.0))
    assert value_of(spark, anchored) == 105.0
    nothing = F.lit(None).cast("double")
    assert value_of(spark, timeindex.clock_seconds(F.lit(10.0), F.lit("none"), nothing, nothing)) is None
    label = timeindex.index_label(
        F.lit(70.0), F.lit(10.0), F.lit("clock"), F.lit("elapsed"), nothing, nothing
    )
    assert value_of(spark, label) == "00:01:00"


def test_unit_factor(spark):
    assert value_of(spark, timeindex.time_unit_factor(F.lit(" MS "))) == 0.001
    assert value_of(spark, timeindex.time_unit_factor(F.lit("weeks"))) == 1.0
    assert math.isclose(value_of(spark, timeindex.time_unit_factor(F.lit("Days"))), 86400.0)
