"""Quality control of curves and indexes, over all datasets in one job.

The raw index axis is read once: steps are reduced to one row per distinct step
of a dataset, carrying counts and the first place the step occurs. Every index
rule, and the median step they compare with, works on that reduced table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveframe.functions.numeric import (
    column,
    interval,
    is_finite,
    percent_text,
    ratio,
    rounded_ratio,
    within,
)
from curveframe.functions.text import strip
from curveframe.operators.chunks import CHUNK_ROWS, lag_by_chunk
from curveframe.operators.median import weighted_median
from curveframe.schema import CHANNEL_KEYS, DATASET_KEYS, RULE_VERSION
from curveframe.session import cut_lineage

# Rule thresholds.
EXCESSIVE_NULL_RATIO = 0.2
IRREGULAR_STEP_TOLERANCE = 0.1
LARGE_GAP_FACTOR = 10.0
CONSTANT_TOLERANCE = 1e-12
CHECKS_PER_CURVE = 4
INDEX_CHECKS = 6


def index_steps(axis: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distinct index steps per dataset with counts and first occurrence.

    Rows without a predecessor, or with a null end, form the null-step group so
    that the invalid count covers every row.
    """
    lagged = lag_by_chunk(
        axis.select(*DATASET_KEYS, "ordinal", "index"), "index", "previous", chunk_rows=chunk_rows
    )
    return lagged.groupBy(*DATASET_KEYS, (F.col("index") - F.col("previous")).alias("delta")).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~is_finite("index")).alias("invalid"),
        F.min("ordinal").alias("first_ordinal"),
        F.min_by("previous", "ordinal").alias("first_previous"),
        F.min_by("index", "ordinal").alias("first_index"),
    )


def typical_step(steps: DataFrame) -> DataFrame:
    """Median size of the finite, non-zero steps of a dataset."""
    sized = steps.where(is_finite("delta") & (F.col("delta") != 0)).withColumn(
        "size", F.abs("delta")
    )
    return weighted_median(sized, DATASET_KEYS, "size", "steps", "typical_step")


def _profile_columns() -> list[Column]:
    delta, typical = F.col("delta"), F.col("typical_step")
    size = F.abs(delta)
    large = size > typical * LARGE_GAP_FACTOR
    conditions = {
        "duplicate": delta == 0,
        "positive": delta > 0,
        "negative": delta < 0,
        "irregular": (typical > 0)
        & (delta != 0)
        & (F.abs(size - typical) > typical * IRREGULAR_STEP_TOLERANCE)
        & (size <= typical * LARGE_GAP_FACTOR),
        "large_gap": (typical > 0) & large,
    }
    columns = [F.sum("invalid").alias("invalid_count")]
    for name, condition in conditions.items():
        columns.append(
            F.coalesce(F.sum(F.when(condition, F.col("steps"))), F.lit(0)).alias(f"{name}_count")
        )
    columns.append(F.max("typical_step").alias("typical_step"))
    for name, condition in conditions.items():
        order = F.when(condition, F.col("first_ordinal"))
        columns.append(F.min_by("first_previous", order).alias(f"{name}_previous"))
        columns.append(F.min_by("first_index", order).alias(f"{name}_index"))
    return columns


def index_profile(axis: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts of index faults and the first (previous, current) pair of each kind.

    The step table is kept: the median and the counts read it, the axis is not
    read again.
    """
    steps = cut_lineage(index_steps(axis, chunk_rows))
    return (
        steps.join(typical_step(steps), DATASET_KEYS, "left")
        .groupBy(*DATASET_KEYS)
        .agg(*_profile_columns())
    )


def _issue(
    condition: Column,
    code: str,
    severity: str,
    scope: str,
    message: Column,
    evidence: dict[str, Column],
    count: Column,
    measure: Column | None = None,
    bounds: tuple[Column, Column] | None = None,
) -> Column:
    """One issue struct, null where the rule does not fire."""
    no_number = F.lit(None).cast("double")
    pairs: list[Column] = []
    for name, value in evidence.items():
        pairs += [F.lit(name), value.cast("string")]
    low, high = bounds or (no_number, no_number)
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.lit(scope).alias("scope"),
            message.alias("message"),
            F.create_map(*pairs).alias("evidence"),
            count.cast("bigint").alias("evidence_count"),
            (no_number if measure is None else measure).alias("evidence_value"),
            low.alias("index_minimum"),
            high.alias("index_maximum"),
        ),
    )


def _explode_issues(df: DataFrame, carried: Sequence[Column], issues: Sequence[Column]) -> DataFrame:
    fired = df.select(*carried, F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    return fired.select(
        *DATASET_KEYS,
        "issue.code",
        "issue.severity",
        "issue.scope",
        "issue.message",
        "issue.evidence",
        "issue.evidence_count",
        "issue.evidence_value",
        F.lit(RULE_VERSION).alias("rule_version"),
        "curve_id",
        "curve_mnemonic",
        "issue.index_minimum",
        "issue.index_maximum",
    )


def _counted(template: str, count: str) -> Column:
    return F.format_string(template, F.col(count))


def index_issues(profile: DataFrame) -> DataFrame:
    """Rules over the index profile."""
    positive, negative = F.col("positive_count"), F.col("negative_count")
    mostly_rising = positive >= negative
    reversals = F.when(mostly_rising, negative).otherwise(positive)
    turn = tuple(
        F.when(mostly_rising, down).otherwise(up)
        for down, up in zip(
            interval("negative_previous", "negative_index"),
            interval("positive_previous", "positive_index"),
            strict=True,
        )
    )
    # Codes, severities and messages of the index rules.
    rules = [
        _issue(
            F.col("invalid_count") > 0, "INDEX_INVALID", "error", "dataset",
            _counted("The canonical index contains %d invalid samples.", "invalid_count"),
            {"invalid_count": F.col("invalid_count")}, F.col("invalid_count"),
        ),
        _issue(
            F.col("duplicate_count") > 0, "INDEX_DUPLICATE", "error", "dataset",
            _counted("The canonical index contains %d duplicate steps.", "duplicate_count"),
            {"duplicate_count": F.col("duplicate_count")}, F.col("duplicate_count"),
            bounds=interval("duplicate_previous", "duplicate_index"),
        ),
        _issue(
            (positive > 0) & (negative > 0), "INDEX_NON_MONOTONIC", "error", "dataset",
            F.format_string("The canonical index reverses direction %d times.", reversals),
            {"reversal_count": reversals}, reversals, bounds=turn,
        ),
        _issue(
            (positive == 0) & (negative > 0), "INDEX_REVERSED", "info", "dataset",
            F.lit("The canonical index is stored in descending order."),
            {"descending_step_count": negative}, negative,
            bounds=interval("negative_previous", "negative_index"),
        ),
        _issue(
            F.col("irregular_count") > 0, "INDEX_IRREGULAR_STEP", "warning", "dataset",
            _counted("The canonical index contains %d irregular steps.", "irregular_count"),
            {
                "irregular_step_count": F.col("irregular_count"),
                "typical_step": F.col("typical_step"),
            },
            F.col("irregular_count"), F.col("typical_step"),
            interval("irregular_previous", "irregular_index"),
        ),
        _issue(
            F.col("large_gap_count") > 0, "INDEX_LARGE_GAP", "warning", "dataset",
            _counted("The canonical index contains %d large gaps.", "large_gap_count"),
            {
                "large_gap_count": F.col("large_gap_count"),
                "typical_step": F.col("typical_step"),
            },
            F.col("large_gap_count"), F.col("typical_step"),
            interval("large_gap_previous", "large_gap_index"),
        ),
    ]
    none = F.lit(None).cast("string")
    return _explode_issues(
        profile, [*map(column, DATASET_KEYS), none.alias("curve_id"), none.alias("curve_mnemonic")],
        rules,
    )


def mnemonic_frequency(channels: DataFrame) -> DataFrame:
    """How many channels of the dataset share a mnemonic, letter case ignored."""
    folded = channels.withColumn("folded", F.lower("mnemonic"))
    counts = folded.groupBy(*DATASET_KEYS, "folded").agg(F.count(F.lit(1)).alias("duplicate_count"))
    return folded.join(counts, [*DATASET_KEYS, "folded"]).drop("folded")


def scalar_channels(channels: DataFrame) -> DataFrame:
    return channels.where((F.col("storage_kind") == "parquet") & (F.size("sample_shape") == 0))


def with_statistics(channels: DataFrame, statistics: DataFrame) -> DataFrame:
    """Channel catalog with figures measured on the samples."""
    figures = ["minimum", "maximum", "sample_count", "null_count"]
    measured = statistics.select(*CHANNEL_KEYS, *figures, "invalid_count")
    return channels.drop(*figures).join(measured, CHANNEL_KEYS, "left")


def curve_issues(channels: DataFrame) -> DataFrame:
    """Rules over channels that carry their statistics and ``invalid_count``.

    Text channels take part in the catalog rules but have no numeric rule.
    """
    scalar = mnemonic_frequency(scalar_channels(channels))
    null_ratio = ratio("null_count", "sample_count")
    present = F.col("sample_count") - F.col("null_count")
    name = F.col("mnemonic")
    # Codes, severities and messages of the curve rules.
    rules = [
        _issue(
            strip("unit") == "", "CURVE_UNIT_MISSING", "warning", "curve",
            F.format_string("%s does not define a unit.", name),
            {"unit": F.col("unit")}, F.lit(None),
        ),
        _issue(
            (F.col("sample_count") > 0) & (null_ratio >= EXCESSIVE_NULL_RATIO),
            "CURVE_EXCESSIVE_NULLS", "warning", "curve",
            F.format_string("%s contains %s null samples.", name, percent_text(null_ratio)),
            {
                "null_count": F.col("null_count"),
                "sample_count": F.col("sample_count"),
                "null_ratio": rounded_ratio(null_ratio),
            },
            F.col("null_count"), rounded_ratio(null_ratio),
        ),
        _issue(
            (present > 1) & within("minimum", "maximum", CONSTANT_TOLERANCE),
            "CURVE_CONSTANT", "warning", "curve",
            F.format_string("%s is constant across all non-null samples.", name),
            {"value": F.col("minimum"), "non_null_count": present}, present, F.col("minimum"),
        ),
        _issue(
            F.col("duplicate_count") > 1, "CURVE_DUPLICATE_MNEMONIC", "warning", "curve",
            F.format_string("%s is used by %d curves in this dataset.", name, F.col("duplicate_count")),
            {"duplicate_count": F.col("duplicate_count")}, F.col("duplicate_count"),
        ),
        _issue(
            (F.col("data_type") == "numeric") & (F.col("invalid_count") > 0),
            "CURVE_INVALID_NUMERIC", "error", "curve",
            F.format_string("%s contains %d non-finite values.", name, F.col("invalid_count")),
            {"invalid_count": F.col("invalid_count")}, F.col("invalid_count"),
        ),
    ]
    return _explode_issues(
        scalar,
        [
            *map(column, DATASET_KEYS),
            F.col("channel_id").alias("curve_id"),
            F.col("mnemonic").alias("curve_mnemonic"),
        ],
        rules,
    )


def issue_order() -> list[Column]:
    rank = (
        F.when(F.col("severity") == "error", 0)
        .when(F.col("severity") == "warning", 1)
        .otherwise(2)
    )
    return [*map(column, DATASET_KEYS), rank, F.coalesce("curve_mnemonic", F.lit("")), F.col("code")]


def quality_issues(channels: DataFrame, axis: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All issues of all datasets that have scalar channels, in report order."""
    readable = scalar_channels(channels).select(*DATASET_KEYS).distinct()
    of_index = index_issues(index_profile(axis, chunk_rows)).join(readable, DATASET_KEYS, "left_semi")
    return curve_issues(channels).unionByName(of_index).orderBy(*issue_order())


def quality_summary(channels: DataFrame, issues: DataFrame) -> DataFrame:
    """Checks run and issues found per dataset, also for datasets without issues."""
    checks = (
        scalar_channels(channels)
        .groupBy(*DATASET_KEYS)
        .agg((F.count(F.lit(1)) * CHECKS_PER_CURVE + INDEX_CHECKS).alias("checks_run"))
    )
    found = issues.groupBy(*DATASET_KEYS).agg(
        F.count(F.lit(1)).alias("issue_count"),
        *[
            F.count_if(F.col("severity") == severity).alias(f"{severity}_count")
            for severity in ("error", "warning", "info")
        ],
    )
    counts = ["issue_count", "error_count", "warning_count", "info_count"]
    return checks.join(found, DATASET_KEYS, "left").fillna(0, counts)
