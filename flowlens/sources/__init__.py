"""Log and table readers. All return lazy DataFrames over splittable files."""

from flowlens.sources.delimited import (
    scan_csv,
    scan_firewall_csv,
    scan_firewall_export,
    scan_kibana_export,
    scan_labeled,
)
from flowlens.sources.kernel import parse_kernel_lines, scan_kernel_log, skipped_lines
from flowlens.sources.registry import list_parsers, load_logs, register_parser, scan
from flowlens.sources.syslog import parse_syslog_lines, scan_syslog
from flowlens.sources.tables import (
    load_flows_parquet,
    parquet_profile,
    scan_parquet,
    scan_parquet_period,
)

__all__ = [name for name in dir() if not name.startswith("_")]
