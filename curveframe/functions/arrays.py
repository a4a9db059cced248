"""Figures over the elements of an array, inside its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fold that appends to an array copies it, so elements are folded in chunks of this many.
CHUNK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once.

    A column that a lambda mentions may be put in its place by the optimizer and then be
    worked out for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sum of an integer array's elements up to and with each one.

    Folded chunk by chunk; each chunk is then shifted by the sum of the chunks before it,
    which are 256 times fewer.
    """
    none = F.array().cast("array<int>")

    def fold(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), none.alias("sums"))
        return F.aggregate(
            values,
            start,
            lambda held, value: F.struct(
                (held["sum"] + value).alias("sum"), F.concat(held["sums"], F.array(held["sum"] + value)).alias("sums")
            ),
        )

    def chunks(values: Column) -> Column:
        count = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none)
        return F.transform(places, lambda at: fold(F.slice(values, at * CHUNK + 1, F.lit(CHUNK))))

    def shifted(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda part: part["sum"]))["sums"]
        zipped = F.arrays_zip(parts.alias("part"), before.alias("through"))
        return F.flatten(
            F.transform(
                zipped,
                lambda item: F.transform(
                    item["part"]["sums"], lambda value: value + item["through"] - item["part"]["sum"]
                ),
            )
        )

    return let(numbers, lambda values: let(chunks(values), shifted))
