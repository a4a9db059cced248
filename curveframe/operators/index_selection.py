"""Index candidates of parsed tables, their quality, and the choice between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.functions.arrays import let
from curveframe.functions.numeric import is_finite
from curveframe.functions.text import column_slug, non_empty
from curveframe.functions.timeindex import (
    date_time_epoch,
    index_kind,
    is_index_mnemonic,
    known_unit_factor,
    time_unit_factor,
)
from curveframe.schema import DATASET_KEYS

# Quality an index candidate must reach.
MINIMUM_VALID = 0.8
MINIMUM_MONOTONIC = 0.95

ZONE_WARNING = (
    "The LAS DATE and TIME values do not specify a timezone; UTC was assumed for "
    "deterministic timestamp normalization."
)


def pair_dates(cells: DataFrame, curves: DataFrame) -> DataFrame:
    """TIME text columns paired with the first DATE column, row by row.

    Gives ``position``, ``date_position``, ``ordinal`` and ``index`` (epoch seconds).
    """
    dates = (
        curves.where(F.lower("mnemonic") == "date")
        .groupBy(*DATASET_KEYS)
        .agg(F.min("position").alias("date_position"))
    )
    times = curves.where((F.lower("mnemonic") == "time") & ~F.col("is_numeric"))
    pairs = times.select(*DATASET_KEYS, "position").join(dates, DATASET_KEYS)
    time_cells = cells.join(pairs, [*DATASET_KEYS, "position"]).withColumnRenamed("raw", "time_text")
    date_cells = cells.select(
        *DATASET_KEYS,
        F.col("position").alias("date_position"),
        "ordinal",
        F.col("raw").alias("date_text"),
    )
    return time_cells.join(date_cells, [*DATASET_KEYS, "date_position", "ordinal"]).select(
        *DATASET_KEYS,
        "position",
        "date_position",
        "ordinal",
        "time_text",
        "date_text",
        date_time_epoch("date_text", "time_text").alias("index"),
    )


def _places(first: Column, size: Column, width: Column) -> Column:
    """Places of a column's cells among ``size`` cells that stand row by row."""
    return F.when(first < size, F.sequence(first, size - 1, width)).otherwise(F.array().cast("array<int>"))


def text_positions(tokens: str, numbers: str, width: str) -> Column:
    """Positions of columns in which some cell is neither blank nor a number."""
    bad = F.transform(numbers, lambda number, at: F.when(number.isNull() & (F.get(tokens, at) != ""), at % F.col(width)))
    return F.array_distinct(F.array_compact(bad))


def candidate_facts(
    tokens: str,
    numbers: str,
    mnemonics: str,
    width: str,
    value: Callable[[Column, Column], Column],
    sentinel: str = "sentinel",
) -> Column:
    """What the cells of a part say about each column that may be an index.

    Counts, rises and falls over the finite values, and the first and last of them, so
    that the facts of the parts of a file can be added up. A known mnemonic or the first
    place makes a column a candidate; TIME is one as text, too, where there is a DATE.
    """
    size = F.size(tokens)
    names = F.transform(mnemonics, F.lower)
    date = F.array_position(names, F.lit("date")).cast("int") - 1
    state = F.struct(
        *[F.lit(0).cast("bigint").alias(name) for name in ("rows", "finite", "rising", "falling")],
        F.lit(None).cast("double").alias("first"),
        F.lit(None).cast("double").alias("last"),
    )

    def step(held: Column, index: Column) -> Column:
        good = is_finite(index)
        more = lambda condition: F.when(good & condition, 1).otherwise(0)
        return F.struct(
            (held["rows"] + 1).alias("rows"),
            (held["finite"] + more(F.lit(True))).alias("finite"),
            (held["rising"] + more(index >= held["last"])).alias("rising"),
            (held["falling"] + more(index <= held["last"])).alias("falling"),
            F.when(good & held["first"].isNull(), index).otherwise(held["first"]).alias("first"),
            F.when(good, index).otherwise(held["last"]).alias("last"),
        )

    def fact(position: Column, date: Column, index: Callable[[Column], Column]) -> Column:
        values = F.transform(_places(position, size, F.col(width)), index)
        return F.struct(
            position.alias("position"), date.cast("int").alias("date_position"), F.aggregate(values, state, step).alias("found")
        )

    def facts(name: Column, position: Column, dates: Column) -> Column:
        numeric = fact(position, F.lit(None), lambda place: value(F.get(numbers, place), F.col(sentinel)))
        paired = fact(
            position, dates, lambda place: date_time_epoch(F.get(tokens, place - position + dates), F.get(tokens, place))
        )
        return F.array_compact(
            F.array(
                F.when(is_index_mnemonic(name) | (position == 0), numeric), F.when((name == "time") & (dates >= 0), paired)
            )
        )

    return let(date, lambda dates: F.flatten(F.transform(names, lambda name, position: facts(name, position, dates))))


def candidate_structs(facts: str, curves: str, row_count: str) -> Column:
    """Credible candidates by position, from added-up facts and typed curves.

    A numeric column qualifies by quality; TIME text qualifies with a DATE column.
    """

    def described(fact: Column) -> Column:
        found, curve = fact["found"], F.get(curves, fact["position"])
        is_pair = fact["date_position"].isNotNull()
        finite, mnemonic, unit = found["finite"], curve["mnemonic"], curve["unit"]
        kind = F.when(is_pair, "time").otherwise(index_kind(mnemonic))
        is_time = kind == "time"
        monotonic = F.greatest(found["rising"], found["falling"]).cast("double") / F.nullif(finite - 1, F.lit(0))
        return F.struct(
            F.when(is_pair, F.format_string("date-time:%d:%d", fact["position"], fact["date_position"]))
            .otherwise(F.format_string("curve:%d", fact["position"]))
            .alias("candidate_id"),
            fact["position"].alias("source_position"),
            fact["date_position"].alias("date_position"),
            F.when(is_pair, "TIME").otherwise(mnemonic).alias("mnemonic"),
            F.when(is_time, "s").otherwise(unit).alias("unit"),
            kind.alias("kind"),
            (finite.cast("double") / F.nullif(F.col(row_count), F.lit(0))).alias("valid_ratio"),
            F.when(finite >= 2, monotonic).otherwise(F.lit(0.0)).alias("monotonic_ratio"),
            finite.alias("finite_count"),
            (F.col(row_count) - finite).alias("invalid_count"),
            # Reasons.
            F.when(is_pair, "Paired DATE and TIME columns form a monotonic timestamp index.")
            .when(
                is_index_mnemonic(mnemonic), F.concat(mnemonic, F.lit(" has a recognized index mnemonic and monotonic values."))
            )
            .otherwise("The first numeric curve is monotonic.")
            .alias("reason"),
            F.when(is_pair, "absolute_utc").when(is_time, "elapsed").otherwise("none").alias("time_reference"),
            F.when(is_time & ~is_pair, time_unit_factor(unit)).otherwise(F.lit(1.0)).alias("factor"),
            (is_time & ~is_pair & known_unit_factor(unit).isNull()).alias("assumed_seconds"),
        )

    suited = F.filter(facts, lambda fact: F.get(curves, fact["position"])["is_numeric"] == fact["date_position"].isNull())
    return F.filter(
        F.transform(suited, described),
        lambda item: (item["valid_ratio"] >= MINIMUM_VALID) & (item["monotonic_ratio"] >= MINIMUM_MONOTONIC),
    )


def chosen_candidate(candidates: str, requested: str, take_first: bool) -> Column:
    """(status, candidate): the choice between a dataset's candidates, null where there are none.

    The requested candidate if there is one; else the only one. Of several, the first
    counts with ``take_first``, and without it the dataset is ``INDEX_SELECTION_REQUIRED``.
    """
    asked = F.col(requested).isNotNull()
    match = F.get(F.filter(candidates, lambda item: item["candidate_id"] == F.col(requested)), F.lit(0))
    first = F.get(candidates, F.lit(0))
    status = (
        F.when(asked & match.isNull(), "INDEX_CANDIDATE_UNKNOWN")
        .when(~asked & (F.size(candidates) > 1) & F.lit(not take_first), "INDEX_SELECTION_REQUIRED")
        .otherwise("OK")
    )
    return F.when(F.size(candidates) > 0, F.struct(status.alias("status"), F.coalesce(match, first).alias("candidate")))


def candidate_warnings(choice: DataFrame) -> DataFrame:
    """Warnings that follow from a choice, one row each."""
    chosen = choice.where(F.col("status") == "OK")
    is_pair = F.col("date_position").isNotNull()
    # Warnings.
    notes = F.array_compact(
        F.array(
            F.when(is_pair, ZONE_WARNING),
            F.when(
                is_pair & (F.col("invalid_count") > 0),
                F.format_string(
                    "%d LAS DATE/TIME rows could not be parsed and have a null index.",
                    "invalid_count",
                ),
            ),
            F.when(
                F.col("assumed_seconds"),
                F.format_string(
                    "The numeric %s index unit was not recognized; seconds were assumed.",
                    "mnemonic",
                ),
            ),
        )
    )
    return chosen.select("document_id", F.posexplode(notes).alias("ordinal", "message"))


def unique_column_names(
    channels: DataFrame, reserved: tuple[str, ...] = ("index",), position: str = "position"
) -> DataFrame:
    """Table column of each channel: its slug, with ``_position`` after a repeat.

    A name that collides again after the suffix gets the position once more.
    """
    named = channels.withColumn("slug", column_slug("mnemonic"))
    use = F.row_number().over(Window.partitionBy(*DATASET_KEYS, "slug").orderBy(position))
    suffixed = F.concat_ws("_", "slug", F.col(position).cast("string"))
    first = named.withColumn(
        "column_name",
        F.when((use == 1) & ~F.col("slug").isin(*reserved), F.col("slug")).otherwise(suffixed),
    )
    again = F.row_number().over(Window.partitionBy(*DATASET_KEYS, "column_name").orderBy(position))
    return first.withColumn(
        "column_name",
        F.when(again == 1, F.col("column_name")).otherwise(
            F.concat_ws("_", "column_name", F.col(position).cast("string"))
        ),
    ).drop("slug")


def mnemonic_or(fallback: str, mnemonic: str = "mnemonic", position: str = "position"):
    """Mnemonic text, or ``<fallback>_<position>`` when it is blank."""
    return F.coalesce(
        non_empty(mnemonic), F.concat_ws("_", F.lit(fallback), F.col(position).cast("string"))
    )
