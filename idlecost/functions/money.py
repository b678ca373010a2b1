"""Exact totals.

Per-row amounts (dollars, DBUs) are doubles.  Totals are summed as whole
millionths (bigint): the sum is then exact and independent of row order and
partitioning, and it is converted back to a double once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_micros(value: Column | str) -> Column:
    """An amount as whole millionths (rounded half away from zero)."""
    return F.round(_col(value) * F.lit(MICRO)).cast("long")


def from_micros(micros: Column | str) -> Column:
    return _col(micros).cast("double") / F.lit(MICRO)


def sum_micros(value: Column | str) -> Column:
    """Exact total in millionths (null when every row is null)."""
    return F.sum(to_micros(value))


def sum_exact(value: Column | str) -> Column:
    """Exact total of an amount column (null when every row is null)."""
    return from_micros(sum_micros(value))


# dollars are the common case
sum_usd = sum_exact
