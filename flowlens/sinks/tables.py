"""Table writers. Every task writes its own part file; nothing is gathered first."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: rows of the browser export.
EXPORT_CAP = 100_000
# Metadata of a time column: the partition column that holds its day.
STORED_DAY = "stored_day"


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> str:
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def write_flows(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> str:
    """Flows by day, so that time filters read only their days; a column ``day`` of the flows' own is refused.

    Rebalancing keeps the files per day few and splits a very busy day over several tasks.
    """
    if "day" in df.columns and STORED_DAY not in df.schema[date].metadata:
        raise ValueError("the flows have a column 'day', which would be replaced by the day of their time")
    marked = F.col(date).alias(date, metadata={**df.schema[date].metadata, STORED_DAY: "day"})
    daily = df.withColumn(date, marked).withColumn("day", F.to_date(date)).hint("rebalance", F.col("day"))
    daily.write.mode(mode).partitionBy("day").parquet(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    return export_csv(df, path, mode) if fmt == "csv" else write_parquet(df, path, mode=mode)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def export_capped(df: DataFrame, path: str, key: str, cap: int | None = None) -> str:
    """The rows by key: all of them, or the first ``cap`` (``EXPORT_CAP`` in a browser export)."""
    ordered = df.orderBy(key)
    return export_csv(ordered if cap is None else ordered.limit(cap), path)
