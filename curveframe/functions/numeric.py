"""Finite-number handling, tolerances, interpolation and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def try_cast(value: str | Column, kind: str) -> Column:
    """Cast that gives null instead of an error.

    The JVM's own notations (``1.5d``, ``7f``, hexadecimal) are no numbers in curve files.
    """
    cast = column(value).try_cast(kind)
    if kind != "double":
        return cast
    return F.when(~column(value).cast("string").rlike(r"[0-9.][dDfF]\s*$|[xX]"), cast)


def is_finite(value: str | Column) -> Column:
    """True only for a finite number: NaN sorts above infinity, null gives false."""
    return F.coalesce(F.abs(column(value)) < F.lit(INFINITY), F.lit(False))


def finite_or_null(value: str | Column) -> Column:
    value = column(value)
    return F.when(is_finite(value), value)


def finite_number(text: str | Column) -> Column:
    """Number held in text (or any scalar); everything that is no finite number is null."""
    return finite_or_null(try_cast(column(text), "double"))


def nan_to_null(value: str | Column) -> Column:
    value = column(value)
    return F.when(~F.isnan(value), value)


def within(left: str | Column, right: str | Column | float, tolerance: float | Column) -> Column:
    """Absolute-tolerance equality."""
    right = F.lit(right) if isinstance(right, (int, float)) else column(right)
    tolerance = F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance
    return F.abs(column(left) - right) <= tolerance


def cursor_tolerance(query: str | Column) -> Column:
    return F.greatest(F.lit(1e-9), F.abs(column(query)) * F.lit(1e-12))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Straight line through (x0, y0) and (x1, y1), evaluated at x."""
    return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def ratio(part: str | Column, whole: str | Column) -> Column:
    """part / whole as double, 0 for an empty whole."""
    part, whole = column(part).cast("double"), column(whole).cast("double")
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded_ratio(value: str | Column) -> Column:
    return F.bround(column(value), 6)


def percent_text(value: str | Column) -> Column:
    """One-decimal percentage, ties to even."""
    return F.format_string("%.1f%%", F.bround(column(value) * 100, 1))


def interval(previous: str | Column, current: str | Column) -> tuple[Column, Column]:
    """(minimum, maximum) of a pair, both null unless both ends are known."""
    previous, current = column(previous), column(current)
    known = previous.isNotNull() & current.isNotNull()
    return (
        F.when(known, F.least(previous, current)),
        F.when(known, F.greatest(previous, current)),
    )
