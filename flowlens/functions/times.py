"""Zone-free timestamps.

Log times carry no zone, so every function here works on ``timestamp_ntz`` and never
passes through a zoned value, except pattern parsing, which Spark offers zoned only.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def to_timestamp(column: Column, *formats: str) -> Column:
    """ISO text, else the first format that parses, else null."""
    parsed = [as_ntz(F.try_to_timestamp(column, F.lit(f))) for f in formats]
    return F.coalesce(column.try_cast("timestamp_ntz"), *parsed)


def floor_time(column: Column, unit: str) -> Column:
    """Start of the second / hour / day / week (Monday) / month."""
    day = F.to_date(column)
    if unit == "day":
        return as_ntz(day)
    if unit in ("week", "month"):
        return as_ntz(F.trunc(day, unit))
    zero = F.lit(0)
    if unit == "hour":
        return as_ntz(day) + F.make_dt_interval(zero, F.hour(column))
    if unit == "second":
        seconds = F.second(column).cast("decimal(18,6)")
        return as_ntz(day) + F.make_dt_interval(zero, F.hour(column), F.minute(column), seconds)
    raise ValueError(f"unknown unit: {unit}")


def period_label(column: Column, unit: str) -> Column:
    """Text label of a period; a week is 'first day/last day'."""
    day = F.to_date(column)
    if unit == "hour":
        return F.date_format(floor_time(column, "hour"), "yyyy-MM-dd HH:00")
    if unit == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(day, "yyyy-MM")
    monday = F.trunc(day, "week")
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"),
        F.lit("/"),
        F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"),
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds, fractions kept, as double."""
    span = (later - earlier).cast("interval second")
    return span.cast("decimal(18,6)").cast("double")


def is_night(column: Column) -> Column:
    """22:00 to 05:59; a missing time is not night."""
    hour = F.hour(column)
    return F.coalesce((hour >= 22) | (hour < 6), F.lit(False))


def is_weekend(column: Column) -> Column:
    return F.coalesce(F.weekday(column) >= 5, F.lit(False))
