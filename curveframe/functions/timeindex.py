"""Index kinds, time units, date parsing and time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curveframe.functions.numeric import column, finite_number, is_finite, try_cast
from curveframe.functions.text import strip

# Mnemonics that name an index, and seconds per time unit.
DEPTH_MNEMONICS = ("dept", "depth", "md", "mdepth")
TVD_MNEMONICS = ("tvd", "tvdss", "tvdepth")
TIME_MNEMONICS = ("time", "etime", "elapsed", "seconds", "sec")
FRAME_DEPTH_MNEMONICS = ("dept", "depth", "md")
SECONDS_PER_UNIT = {
    1.0: ("s", "sec", "second", "seconds"),
    0.001: ("ms", "millisecond", "milliseconds"),
    60.0: ("min", "minute", "minutes"),
    3600.0: ("h", "hr", "hour", "hours"),
    86400.0: ("d", "day", "days"),
}
DATE_TIME_PATTERNS = (
    "d-MMM-yy H:m:s",
    "d-MMM-yy H:m:s.SSSSSS",
    "d-MMM-yyyy H:m:s",
    "d-MMM-yyyy H:m:s.SSSSSS",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
)


def known_unit_factor(unit: str | Column) -> Column:
    """Seconds per unit, null for an unknown spelling."""
    spelling = F.lower(strip(unit))
    factor = F.lit(None).cast("double")
    for seconds, spellings in SECONDS_PER_UNIT.items():
        factor = F.when(spelling.isin(*spellings), F.lit(seconds)).otherwise(factor)
    return factor


def time_unit_factor(unit: str | Column) -> Column:
    """Seconds per unit; unknown units count as seconds."""
    return F.coalesce(known_unit_factor(unit), F.lit(1.0))


def is_index_mnemonic(mnemonic: str | Column) -> Column:
    return F.lower(column(mnemonic)).isin(*DEPTH_MNEMONICS, *TVD_MNEMONICS, *TIME_MNEMONICS)


def index_kind(mnemonic: str | Column) -> Column:
    """Kind of a numeric index, from its mnemonic alone."""
    name = F.lower(column(mnemonic))
    return (
        F.when(name.isin(*DEPTH_MNEMONICS), "measured_depth")
        .when(name.isin(*TVD_MNEMONICS), "true_vertical_depth")
        .when(name.isin(*TIME_MNEMONICS), "time")
        .otherwise("other")
    )


def frame_index_kind(index_type: str | Column, mnemonic: str | Column) -> Column:
    kind = F.lower(F.coalesce(column(index_type), F.lit("")))
    return (
        F.when(
            F.contains(kind, F.lit("depth"))
            | F.lower(column(mnemonic)).isin(*FRAME_DEPTH_MNEMONICS),
            "measured_depth",
        )
        .when(F.contains(kind, F.lit("time")), "time")
        .otherwise("sample")
    )


def log_index_kind(index_type: str | Column) -> Column:
    """Kind of an XML log index: anything that mentions time, else depth."""
    kind = F.lower(F.coalesce(column(index_type), F.lit("")))
    return F.when(F.contains(kind, F.lit("time")), "time").otherwise("measured_depth")


def time_reference(value: str | Column) -> Column:
    """Stored reference, anything unknown reads as ``none``."""
    value = column(value)
    return F.when(value.isin("elapsed", "absolute_utc"), value).otherwise(F.lit("none"))


def default_display_mode(reference: str | Column) -> Column:
    return F.when(column(reference) == "absolute_utc", "clock").otherwise("elapsed")


def epoch_seconds(timestamp: str | Column) -> Column:
    return F.unix_micros(column(timestamp).cast("timestamp")) / F.lit(1e6)


def date_time_epoch(date: str | Column, time: str | Column) -> Column:
    """UTC epoch seconds of a DATE and TIME text pair, null when no pattern fits.

    Two-digit years 69-99 belong to the 1900s; the parser reads them as 2000s.
    """
    text = F.concat_ws(" ", strip(date), strip(time))
    parsed = F.coalesce(
        *[F.try_to_timestamp(text, F.lit(pattern)) for pattern in DATE_TIME_PATTERNS]
    )
    two_digits = F.rlike(text, F.lit(r"^\d{1,2}-[A-Za-z]{3}-\d{2} "))
    parsed = F.when(
        two_digits & (F.year(parsed) >= 2069), parsed + F.make_interval(F.lit(-100))
    ).otherwise(parsed)
    return epoch_seconds(parsed)


def iso_epoch(text: str | Column) -> Column:
    """UTC epoch seconds of ISO-8601 text; text without a zone counts as UTC."""
    value = strip(text)
    dated = F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]|$)"))
    return F.when(dated, epoch_seconds(try_cast(value, "timestamp")))


def canonical_index(raw: Column, any_numeric: Column, any_dated: Column, ordinal: Column) -> Column:
    """Numeric index, else ISO dates, else the row ordinal - decided per dataset."""
    return (
        F.when(any_numeric, finite_number(raw))
        .when(any_dated, iso_epoch(raw))
        .otherwise(ordinal.cast("double"))
    )


def clock_seconds(
    index: str | Column,
    reference: str | Column,
    anchor_index: str | Column,
    anchor_timestamp: str | Column,
) -> Column:
    """Epoch seconds behind an index value: manual anchor first, then absolute time."""
    index, anchor_index, anchor_timestamp = map(column, (index, anchor_index, anchor_timestamp))
    anchored = anchor_index.isNotNull() & anchor_timestamp.isNotNull()
    return F.when(anchored, anchor_timestamp + (index - anchor_index)).when(
        column(reference) == "absolute_utc", index
    )


def elapsed_label(seconds: str | Column) -> Column:
    """``[-][Nd ]HH:MM:SS`` of seconds rounded half up."""
    rounded = F.floor(column(seconds) + F.lit(0.5)).cast("bigint")
    total = F.abs(rounded)
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    days = F.floor(total / 86400).cast("bigint")
    clock = F.concat_ws(
        ":",
        two(F.floor((total % 86400) / 3600).cast("bigint")),
        two(F.floor((total % 3600) / 60).cast("bigint")),
        two((total % 60).cast("bigint")),
    )
    return F.concat(
        F.when(column(seconds) < 0, "−").otherwise(""),
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""),
        clock,
    )


def clock_label(epoch: str | Column, zone: str = "UTC") -> Column:
    moment = F.timestamp_micros((column(epoch) * F.lit(1e6)).cast("bigint"))
    return F.date_format(F.from_utc_timestamp(moment, zone), "dd MMM HH:mm:ss")


def index_label(
    index: str | Column,
    index_minimum: str | Column,
    display_mode: str | Column,
    reference: str | Column,
    anchor_index: str | Column,
    anchor_timestamp: str | Column,
    zone: str = "UTC",
) -> Column:
    """Label of a time index: clock text where a wall clock is known, else elapsed."""
    epoch = clock_seconds(index, reference, anchor_index, anchor_timestamp)
    elapsed = elapsed_label(column(index) - column(index_minimum))
    return F.when(
        (column(display_mode) == "clock") & is_finite(epoch), clock_label(epoch, zone)
    ).otherwise(elapsed)
