"""Readers by name."""

from pyspark.sql import DataFrame, SparkSession

from flowlens.errors import ParsingError
from flowlens.operators.quality import CHECKS, require_valid
from flowlens.sources.delimited import (
    scan_csv,
    scan_firewall_csv,
    scan_firewall_export,
    scan_kibana_export,
)
from flowlens.sources.kernel import scan_kernel_log
from flowlens.sources.syslog import scan_syslog

_READERS = {
    "firewall": scan_firewall_csv,
    "firewall_export": scan_firewall_export,
    "kibana_export": scan_kibana_export,
    "csv": scan_csv,
    "syslog": scan_syslog,
    "kernel_firewall": scan_kernel_log,
}


def register_parser(name: str, reader) -> None:
    """Adds ``reader(spark, path, **options) -> DataFrame`` under a name."""
    if not callable(reader):
        raise ParsingError(f"reader for '{name}' is not callable")
    _READERS[name] = reader


def list_parsers() -> list[str]:
    return sorted(_READERS)


def scan(spark: SparkSession, fmt: str, path, **options) -> DataFrame:
    if fmt not in _READERS:
        raise ParsingError(f"unknown format '{fmt}', known: {list_parsers()}")
    return _READERS[fmt](spark, path, **options)


def load_logs(spark: SparkSession, fmt: str, path, **options) -> DataFrame:
    """:func:`scan`, then raise unless the result holds rows and passes the format's checks."""
    df = scan(spark, fmt, path, **options)
    if df.isEmpty():
        raise ParsingError(f"no valid {fmt} entries in {path}")
    return require_valid(df, fmt) if fmt in CHECKS else df
