"""Tailing a folder of logs."""

from pyspark.sql import DataFrame, SparkSession

from flowlens.errors import ParsingError
from flowlens.operators.columns import normalize_log_columns
from flowlens.sources.kernel import parse_kernel_lines

FORMATS = ("kernel_firewall", "parquet")


def stream_flows(
    spark: SparkSession, path, fmt: str = "kernel_firewall", year: int | None = None, schema=None, files_per_batch: int | None = None
) -> DataFrame:
    """A streaming flow table over the files that arrive in a folder.

    Kernel logs carry no year: ``year`` says which one holds for all lines (a fall of the month can only
    be seen in a log read whole, see ``scan_kernel_log``). Parquet files need their ``schema``.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "kernel_firewall":
        if year is None:
            raise ParsingError("a stream of kernel logs needs a year")
        return normalize_log_columns(parse_kernel_lines(reader.text(path), year))
    if fmt == "parquet":
        if schema is None:
            raise ParsingError("a stream of Parquet files needs a schema")
        return reader.schema(schema).parquet(path)
    raise ParsingError(f"unknown stream format '{fmt}', known: {FORMATS}")
