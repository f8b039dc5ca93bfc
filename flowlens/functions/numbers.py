"""Counting, division and numeric casts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Number of rows where ``condition`` holds, as an aggregate."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def non_null(column: Column) -> Column:
    return F.count(column)


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.when(denominator == 0, F.lit(default)).otherwise(
        F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole * 100`` rounded half to even; null for an empty whole."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def to_number(column: Column, type_name: str = "double") -> Column:
    """Cast whose failures are null."""
    return column.try_cast(type_name)
