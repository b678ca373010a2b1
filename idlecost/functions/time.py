"""Time as UTC epoch microseconds (bigint).

Intervals are carried as ``start_us`` / ``end_us`` bigint columns: comparisons,
running maxima and day cuts are then exact integer arithmetic inside whole-stage
codegen, with no time-zone or float rounding involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MILLI = 1_000
MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts: Column | str) -> Column:
    """Timestamp (with or without time zone) -> epoch microseconds (session time zone is UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def floor_to(us: Column | str, unit: int) -> Column:
    """Largest multiple of ``unit`` that is <= ``us`` (floor, also for negative values)."""
    c = _col(us)
    return c - F.pmod(c, F.lit(unit))


def floor_div(us: Column | str, unit: int) -> Column:
    """floor(us / unit) as bigint, in integer arithmetic."""
    c = _col(us)
    return F.call_function("div", c - F.pmod(c, F.lit(unit)), F.lit(unit).cast("long"))


def floor_to_second(us: Column | str) -> Column:
    return floor_to(us, MICROS_PER_SECOND)


def floor_to_milli(us: Column | str) -> Column:
    return floor_to(us, MICROS_PER_MILLI)


def seconds_to_us(seconds: Column | str) -> Column:
    """A duration in (fractional) seconds -> whole microseconds, rounded."""
    return F.round(_col(seconds) * F.lit(MICROS_PER_SECOND)).cast("long")


def day_number(us: Column | str) -> Column:
    """Days since 1970-01-01 of an epoch-microsecond instant."""
    return floor_div(us, MICROS_PER_DAY)


def day_start_us(day: Column | str) -> Column:
    """Epoch microseconds of the midnight that starts day number ``day``."""
    return _col(day).cast("long") * F.lit(MICROS_PER_DAY)


def date_of_us(us: Column | str) -> Column:
    return F.date_from_unix_date(day_number(us).cast("int"))


def hours_between(start_us: Column | str, end_us: Column | str) -> Column:
    """Whole seconds between the two instants (each floored to the second), in hours."""
    secs = (floor_to_second(end_us) - floor_to_second(start_us)) / F.lit(MICROS_PER_SECOND)
    return secs.cast("long") / F.lit(3600)


def time_of_day_display(offset_us: Column | str) -> Column:
    """Offset into a day -> '1970-01-01THH:mm:ss' (a full day shows as '1970-01-02T00:00:00')."""
    return F.date_format(F.timestamp_micros(_col(offset_us)), "yyyy-MM-dd'T'HH:mm:ss")
