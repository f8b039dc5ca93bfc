"""Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.columns import normalize_log_columns
from flowlens.operators.filters import filter_period, filter_period_inclusive
from flowlens.sinks.tables import STORED_DAY

PERIOD_COLUMNS = ("timestamp", "src_ip", "dst_ip", "proto", "dst_port", "rule", "action")


def scan_parquet(spark: SparkSession, path, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _days(df: DataFrame, start, end, date_col: str) -> DataFrame:
    """Only the day folders of a period, where the table is stored by the days of ``date_col``.

    ``write_flows`` says so in that column's metadata; any other column called ``day`` is left alone.
    """
    day = df.schema[date_col].metadata.get(STORED_DAY)
    if day is None or dict(df.dtypes).get(day) != "date":
        return df
    stored = df.select("_metadata.file_path").first()
    if stored is None or f"/{day}=" not in stored[0]:
        return df
    return df.filter(F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def load_flows_parquet(
    spark: SparkSession, path, drop_cols=(), date_filter=None, date_col: str = "timestamp"
) -> DataFrame:
    """Stored flows without some columns, optionally in an inclusive time range."""
    df = spark.read.parquet(path)
    if date_filter is not None and date_col in df.columns and date_col not in drop_cols:
        df = filter_period_inclusive(_days(df, *date_filter, date_col), *date_filter, column=date_col)
    return df.drop(*drop_cols)


def scan_parquet_period(spark: SparkSession, path, start: str, end: str) -> DataFrame:
    """The seven report columns of a half-open period under canonical names and actions."""
    df = filter_period(_days(spark.read.parquet(path), start, end, "timestamp"), start, end, "timestamp")
    return normalize_log_columns(df.select(*PERIOD_COLUMNS), "report")


def parquet_profile(spark: SparkSession, path) -> DataFrame:
    """Per file: rows, bytes and number of columns."""
    df = spark.read.parquet(path)
    return (
        df.select("_metadata.file_name", "_metadata.file_size")
        .groupBy("file_name", "file_size")
        .agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
    )
