"""Checks on parsed logs and feature tables, each one aggregation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.errors import ValidationError

# Checks per format. limit = highest accepted percentage of null times.
CHECKS = {
    "firewall": {
        "columns": ["ipsrc", "ipdst", "portdst", "action"],
        "time": ("date", None),
        "actions": ["Permit", "Deny"],
        "source": "ipsrc",
        "source_is_error": False,
    },
    "firewall_export": {
        "columns": ["timestamp", "src_ip", "dst_ip", "action"],
        "time": ("timestamp", 5.0),
        "actions": ["DENY", "PERMIT"],
        "source": "src_ip",
        "source_is_error": True,
    },
    "kibana_export": {
        "columns": ["timestamp", "src_ip", "dst_ip", "action"],
        "time": ("timestamp", 5.0),
        "actions": ["DENY", "PERMIT"],
        "source": "src_ip",
        "source_is_error": True,
    },
    "kernel_firewall": {
        "columns": ["timestamp", "hostname", "action", "src_ip", "dst_ip"],
        "time": ("timestamp", 20.0),
        "actions": ["DENY", "PERMIT", "ACCEPT", "DROP", "REJECT"],
        "source": None,
        "source_is_error": False,
    },
    "syslog": {
        "columns": ["timestamp", "hostname", "process", "message"],
        "time": ("timestamp", 50.0),
        "actions": None,
        "source": None,
        "source_is_error": False,
    },
}


def validate_columns(df: DataFrame, expected) -> list[str]:
    """Expected columns that are missing."""
    return [c for c in expected if c not in df.columns]


def validate_flows(df: DataFrame, fmt: str) -> DataFrame:
    """Rows ``(check_name, value, limit, ok)`` for one format, from a single pass."""
    rules = CHECKS[fmt]
    missing = validate_columns(df, rules["columns"])
    time, limit = rules["time"]
    total = F.count("*")
    share = (
        F.try_divide(F.count_if(F.col(time).isNull()) * 100.0, total) if time in df.columns else F.lit(None)
    )
    bad = (
        F.count_if(~F.col("action").isin(*rules["actions"]))
        if rules["actions"] and "action" in df.columns
        else F.lit(0)
    )
    source = rules["source"]
    null_ips = F.count_if(F.col(source).isNull()) if source in df.columns else F.lit(0)
    one = df.agg(share.alias("s"), bad.alias("b"), null_ips.alias("i"))

    def row(name, value, bound, ok):
        return F.struct(
            F.lit(name).alias("check_name"),
            value.cast("double").alias("value"),
            F.lit(bound).cast("double").alias("limit"),
            ok.alias("ok"),
        )

    rows = [row("missing_columns", F.lit(len(missing)), 0.0, F.lit(not missing))]
    if limit is not None:
        rows.append(
            row("null_time_percent", F.col("s"), limit, F.coalesce(F.col("s") <= limit, F.lit(True)))
        )
    if rules["actions"]:
        rows.append(row("unexpected_actions", F.col("b"), 0.0, F.col("b") == 0))
    if source:
        accepted = F.col("i") == 0 if rules["source_is_error"] else F.lit(True)
        rows.append(row("null_source_ips", F.col("i"), 0.0, accepted))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require_valid(df: DataFrame, fmt: str) -> DataFrame:
    """Returns ``df`` or raises with the failed checks."""
    failed = validate_flows(df, fmt).filter(~F.col("ok")).collect()
    if failed:
        errors = [f"{r['check_name']}: {r['value']} (limit {r['limit']})" for r in failed]
        raise ValidationError(f"data validation failed: {errors}", errors)
    return df


def validate_features(df: DataFrame, required=()) -> DataFrame:
    """Rows ``(check_name, detail, value, ok)``: emptiness, missing columns, null counts."""
    missing = validate_columns(df, required)
    one = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
    )

    def row(name, detail, value, ok):
        return F.struct(
            F.lit(name).alias("check_name"),
            F.lit(detail).alias("detail"),
            value.cast("bigint").alias("value"),
            ok.alias("ok"),
        )

    rows = [row("rows", "", F.col("n"), F.col("n") > 0)]
    rows += [row("missing_column", c, F.lit(1), F.lit(False)) for c in missing]
    rows += [
        row("nulls", c, F.col(f"null_{i}"), F.col(f"null_{i}") == 0)
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_summary(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, row count and null count."""
    one = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("n").alias("n_rows"),
            F.col(f"null_{i}").alias("null_count"),
        )
        for i, f in enumerate(df.schema)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
