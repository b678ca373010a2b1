"""Column expressions shared by the operators (all built-in Spark functions)."""

from idlecost.functions.money import from_micros, sum_exact, sum_micros, sum_usd, to_micros
from idlecost.functions.time import (
    MICROS_PER_DAY,
    MICROS_PER_SECOND,
    date_of_us,
    day_number,
    day_start_us,
    epoch_us,
    floor_div,
    floor_to_second,
    hours_between,
    time_of_day_display,
)

__all__ = [
    "MICROS_PER_DAY",
    "MICROS_PER_SECOND",
    "date_of_us",
    "day_number",
    "day_start_us",
    "epoch_us",
    "floor_div",
    "floor_to_second",
    "hours_between",
    "from_micros",
    "sum_exact",
    "sum_micros",
    "sum_usd",
    "to_micros",
    "time_of_day_display",
]
