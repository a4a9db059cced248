"""Exact weighted median per group.

``percentile`` would keep every distinct value of a group in one task. Here a value
histogram first finds the slice of the value range that holds the middle ranks, a
second histogram splits that slice, and only the values of the final slice are
ranked. The first histogram has
``OCTAVE_STEPS`` buckets per power of two and the second ``SLICE_STEPS`` per bucket,
which leaves at most about a million distinct doubles in a final slice, however
large the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCTAVE_STEPS = 4096
SLICE_STEPS = 1 << 20


def _ranked(histogram: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Running weight before and through each histogram row of a group."""
    window = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return histogram.withColumn("through", start + F.sum("weight").over(window)).withColumn(
        "before", F.col("through") - F.col("weight")
    )


def _holds_middle() -> Column:
    return (F.col("through") >= F.col("low_rank")) & (F.col("before") < F.col("high_rank"))


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, alias: str
) -> DataFrame:
    """Median of positive finite ``value`` counted ``weight`` times, per ``keys``.

    The mean of the two middle values for an even total. ``df`` is read three times
    and should be materialised.
    """
    keys = list(keys)
    values = df.select(
        *keys,
        F.col(value).alias("value"),
        F.col(weight).cast("bigint").alias("weight"),
        F.floor(F.log2(F.col(value)) * OCTAVE_STEPS).cast("bigint").alias("octave"),
    )

    coarse = values.groupBy(*keys, "octave").agg(
        F.sum("weight").alias("weight"),
        F.min("value").alias("slice_low"),
        F.max("value").alias("slice_high"),
    )
    total = F.sum("weight").over(Window.partitionBy(*keys))
    picked = (
        _ranked(coarse, keys, ["octave"], F.lit(0))
        .withColumn("low_rank", F.floor((total + 1) / 2))
        .withColumn("high_rank", F.floor(total / 2) + 1)
        .where(_holds_middle())
        .drop("weight", "through")
    )

    width = F.col("slice_high") - F.col("slice_low")
    step = F.when(
        width > 0, F.floor((F.col("value") - F.col("slice_low")) / width * SLICE_STEPS)
    ).otherwise(F.lit(0))
    sliced = values.join(picked, [*keys, "octave"]).withColumn("step", step.cast("bigint"))
    fine = sliced.groupBy(*keys, "octave", "step", "before", "low_rank", "high_rank").agg(
        F.sum("weight").alias("weight")
    )
    picked_steps = (
        _ranked(
            fine.withColumnRenamed("before", "octave_before"),
            [*keys, "octave"],
            ["step"],
            F.col("octave_before"),
        )
        .where(_holds_middle())
        .select(*keys, "octave", "step", F.col("before").alias("step_before"))
    )

    ranked = _ranked(
        sliced.drop("before").join(picked_steps, [*keys, "octave", "step"]),
        [*keys, "octave", "step"],
        ["value"],
        F.col("step_before"),
    )
    middle = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("through") >= F.col("low_rank"), F.col("value"))).alias("low"),
        F.min(F.when(F.col("through") >= F.col("high_rank"), F.col("value"))).alias("high"),
    )
    return middle.select(*keys, (F.col("low") * 0.5 + F.col("high") * 0.5).alias(alias))
