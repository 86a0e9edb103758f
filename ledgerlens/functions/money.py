"""Money, rates and accounting days as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(12,4)"


def money(value: Column) -> Column:
    """Scale 2, ties away from zero."""
    return value.cast(MONEY)


def rate(value: Column) -> Column:
    """Scale 4, ties away from zero."""
    return value.cast(RATE)


def display(value: Column, scale: int = 2) -> Column:
    """Display rounding: ties to even."""
    return F.bround(value, scale)


def scaled(units: Column, scale: int) -> Column:
    """Exact decimal from an integer count of 10**-scale units."""
    return (units.cast("decimal(18,0)") * F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(
        f"decimal(28,{scale})"
    )


def local_time(instant: Column) -> Column:
    """Business-zone wall clock (UTC+8) of a UTC instant."""
    return instant + F.expr("INTERVAL 8 HOURS")


def local_day(instant: Column) -> Column:
    return F.to_date(local_time(instant))


def accounting_day(instant: Column, reset_hour: Column) -> Column:
    """Business day that starts at ``reset_hour`` local time, as ``yyyy-MM-dd``."""
    return F.date_format(F.to_date(local_time(instant) - F.make_dt_interval(hours=reset_hour)), "yyyy-MM-dd")


def local_iso(wall_clock: Column) -> Column:
    """ISO text of a business-zone wall clock, with its offset."""
    return F.concat(F.date_format(wall_clock, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def day_range(day: Column, reset_hour: Column) -> tuple[Column, Column]:
    """UTC half-open range of an accounting day."""
    start = day.cast("timestamp_ntz") + F.make_dt_interval(hours=reset_hour) - F.expr("INTERVAL 8 HOURS")
    return start, start + F.expr("INTERVAL 1 DAY")
