"""Set operations on flow tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.columns import normalize_log_columns


def union_flows(*tables: DataFrame) -> DataFrame:
    """UNION ALL of several logs in canonical form; absent columns are null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [normalize_log_columns(t) for t in tables],
    )


def unexpected_values(df: DataFrame, column: str, allowed) -> DataFrame:
    """Distinct non-null values outside an allowed set."""
    return df.filter(~F.col(column).isin(*allowed)).select(column).distinct()
