"""Per-source-address behaviour features.

Every set is one ``groupBy(ip).agg(...)``: volume, action, time and port statistics come
out of a single shuffle of map-side partial results, so a dominant address is combined
before it is moved and no per-address join is needed.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.errors import FeatureError
from flowlens.functions import (
    count_where,
    is_deny,
    is_night,
    is_permit,
    is_weekend,
    seconds_between,
)
from flowlens.operators.columns import normalize_feature_names
from flowlens.operators.preparation import correlated_features, variances
from flowlens.schemas import (
    ADMIN_PORTS,
    FEATURES_11,
    FEATURES_RATIO,
    FEATURES_STAT,
    FEATURES_TIME,
    LOW_PORT_MAX,
    VOLUME_FEATURES,
)
from flowlens.session import materialize

EPSILON = 1e-10


@dataclass
class FeatureSet:
    """A feature table, its key column, the feature names and how it was made."""

    data: DataFrame
    feature_names: list
    key: str = "ipsrc"
    metadata: dict = field(default_factory=dict)

    def with_constants(self) -> DataFrame:
        """The table, and the features that were removed because all rows have the same value."""
        values = self.metadata.get("constant_values", {})
        return self.data.withColumns({n: F.lit(value).cast(kind) for n, (value, kind) in values.items()})


def _ip_aggregates(df, dst, port, action, admin_ports, port_threshold) -> list[Column]:
    out = [F.count("*").alias("total_flows")]
    if dst in df.columns:
        out.append(F.count_distinct(F.col(dst)).alias("unique_dst_ips"))
    if port in df.columns:
        out.append(F.count_distinct(F.col(port)).alias("unique_dst_ports"))
    if action not in df.columns:
        return out
    number = F.coalesce(F.col(port).try_cast("double"), F.lit(0.0)) if port in df.columns else None
    for name, chosen in (("permit", is_permit), ("deny", is_deny)):
        hit = chosen(F.col(action))
        out.append(count_where(hit).alias(name))
        for suffix, test in (
            ("low_port", lambda p: p <= port_threshold),
            ("high_port", lambda p: p > port_threshold),
            ("admin", lambda p: p.isin(*[float(a) for a in admin_ports])),
        ):
            value = F.lit(0).cast("bigint") if number is None else count_where(hit & test(number))
            out.append(value.alias(f"{name}_{suffix}"))
    return out


def _time_aggregates(date: str) -> list[Column]:
    """Inputs of the time features; hours are a 24-bit set, not a distinct count."""
    column = F.col(date)
    hour_bit = F.expr(f"shiftleft(1, hour(`{date}`))")
    return [
        F.max(column).alias("_last"),
        F.min(column).alias("_first"),
        F.coalesce(F.bit_count(F.bit_or(hour_bit)), F.lit(0)).cast("bigint").alias("unique_hours"),
        F.avg(is_night(column).cast("int")).alias("night_ratio"),
        F.avg(is_weekend(column).cast("int")).alias("weekend_ratio"),
    ]


def _time_columns(rows: str = "total_flows") -> dict:
    span = seconds_between(F.col("_last"), F.col("_first"))
    return {"time_span_seconds": span, "access_rate": F.col(rows) / (span + 1)}


def _stat_aggregates(column: str) -> list[Column]:
    value = F.col(column).cast("double")
    return [
        F.avg(value).alias("avg_dst_port"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("port_std"),
        F.min(value).alias("port_min"),
        F.max(value).alias("port_max"),
        (F.max(value) - F.min(value)).alias("port_range"),
    ]


def _grouped(df: DataFrame, key: str):
    if key not in df.columns:
        raise FeatureError(f"column '{key}' is not in the table")
    return df.filter(F.col(key).isNotNull()).groupBy(key)


def ip_features(
    df: DataFrame,
    ip_col: str = "ipsrc",
    dst_col: str = "ipdst",
    port_col: str = "portdst",
    action_col: str = "action",
    admin_ports=ADMIN_PORTS,
    port_threshold: int = LOW_PORT_MAX,
) -> DataFrame:
    """Flows, distinct destinations and ports, permits and denies by port class, per address.

    A missing port counts as 0, hence as a low port. Features of a missing column are
    absent, except that port classes are 0 when only the port column is missing.
    """
    aggregates = _ip_aggregates(df, dst_col, port_col, action_col, admin_ports, port_threshold)
    return _grouped(df, ip_col).agg(*aggregates)


def time_features(df: DataFrame, group_col: str = "ipsrc", date_col: str = "date") -> DataFrame:
    """Active span, access rate, distinct hours, night and weekend shares."""
    if date_col not in df.columns:
        raise FeatureError(f"date column '{date_col}' is not in the table")
    grouped = _grouped(df, group_col).agg(F.count("*").alias("_rows"), *_time_aggregates(date_col))
    return grouped.withColumns(_time_columns("_rows")).select(group_col, *FEATURES_TIME)


def port_stats(df: DataFrame, group_col: str = "ipsrc", numeric_col: str = "portdst") -> DataFrame:
    """Mean, sample deviation, min, max and range of a numeric column."""
    return _grouped(df, group_col).agg(*_stat_aggregates(numeric_col))


def ratio_features(df: DataFrame) -> DataFrame:
    """Adds deny share, port diversity, admin share and system-port share where inputs exist."""
    df = normalize_feature_names(df)
    have = set(df.columns)
    total = F.col("total_flows") + EPSILON
    rules = {
        "deny_ratio": (("permit", "deny"), lambda: F.col("deny") / (F.col("permit") + F.col("deny") + EPSILON)),
        "port_diversity": (("unique_dst_ports", "total_flows"), lambda: F.col("unique_dst_ports") / total),
        "admin_ratio": (
            ("permit_admin", "deny_admin", "total_flows"),
            lambda: (F.col("permit_admin") + F.col("deny_admin")) / total,
        ),
        "system_port_ratio": (
            ("permit_low_port", "deny_low_port", "total_flows"),
            lambda: (F.col("permit_low_port") + F.col("deny_low_port")) / total,
        ),
    }
    return df.withColumns({n: make() for n, (needs, make) in rules.items() if have.issuperset(needs)})


def _finish(df, key, names, metadata, remove_correlated, corr_threshold) -> FeatureSet:
    df = materialize(df, "features")  # one pass over the flows; what follows reads the stored table
    spread = variances(df, names)
    constant = [n for n in names if spread[n] == 0]
    names = [n for n in names if n not in constant]
    # Nulls have no part in the variance: a feature with gaps is constant, but no value stands for all rows.
    whole = [F.when(F.count(n) == F.count("*"), F.min(n)).alias(n) for n in constant]
    found = df.agg(*whole).first().asDict() if constant else {}
    correlated = correlated_features(df, names, corr_threshold, spread) if remove_correlated else []
    names = [n for n in names if n not in correlated]
    metadata = {
        **metadata,
        "removed_constant_features": constant,
        "constant_values": {n: (v, df.schema[n].dataType.simpleString()) for n, v in found.items() if v is not None},
        "removed_correlated_features": correlated,
    }
    return FeatureSet(df.select(key, *names), names, key, metadata)


def course_table(df: DataFrame, ip_col="ipsrc", dst_col="ipdst", port_col="portdst", action_col="action", **options):
    """The eleven features in fixed order, zero where their input column is missing."""
    base = ip_features(df, ip_col, dst_col, port_col, action_col, **options)
    return base.select(
        ip_col,
        *[
            F.col(f) if f in base.columns else F.lit(0).cast("bigint").alias(f)
            for f in FEATURES_11
        ],
    )


def course_features(df: DataFrame, remove_correlated=False, corr_threshold=0.95, ip_col="ipsrc", **columns) -> FeatureSet:
    """Eleven features without the constant (and optionally the correlated) ones."""
    table = course_table(df, ip_col=ip_col, **columns)
    return _finish(table, ip_col, FEATURES_11, {"extractor": "course_features"}, remove_correlated, corr_threshold)


def simple_features(df: DataFrame, remove_correlated=False, corr_threshold=0.95, ip_col="ipsrc", **columns) -> FeatureSet:
    """Flow count, distinct destinations and distinct ports only."""
    table = course_table(df, ip_col=ip_col, **columns).select(ip_col, *VOLUME_FEATURES)
    return _finish(table, ip_col, VOLUME_FEATURES, {"extractor": "simple_features"}, remove_correlated, corr_threshold)


def full_table(
    df: DataFrame,
    ip_col="ipsrc",
    dst_col="ipdst",
    port_col="portdst",
    action_col="action",
    date_col="date",
    include_time=True,
    include_ratios=True,
    include_stats=True,
    admin_ports=ADMIN_PORTS,
    port_threshold=LOW_PORT_MAX,
) -> DataFrame:
    """All feature groups in one aggregation."""
    with_time = include_time and date_col and date_col in df.columns
    with_stats = include_stats and port_col in df.columns
    aggregates = _ip_aggregates(df, dst_col, port_col, action_col, admin_ports, port_threshold)
    base = [ip_col] + [f for f in FEATURES_11 if f in _names(df, dst_col, port_col, action_col)]
    if with_time:
        aggregates += _time_aggregates(date_col)
    if with_stats:
        aggregates += _stat_aggregates(port_col)
    table = _grouped(df, ip_col).agg(*aggregates)
    if with_time:
        table = table.withColumns(_time_columns())
    if include_ratios:
        table = ratio_features(table)
    order = base + FEATURES_TIME + FEATURES_RATIO + FEATURES_STAT
    return table.select(*[c for c in order if c in table.columns])


def _names(df, dst, port, action) -> set:
    names = {"total_flows"}
    names |= {"unique_dst_ips"} if dst in df.columns else set()
    names |= {"unique_dst_ports"} if port in df.columns else set()
    return names | (set(FEATURES_11[3:]) if action in df.columns else set())


def full_features(df: DataFrame, remove_correlated=False, corr_threshold=0.95, ip_col="ipsrc", **options) -> FeatureSet:
    """Volume, action, time, ratio and port statistics without the constant features."""
    table = full_table(df, ip_col=ip_col, **options)
    names = [c for c in table.columns if c != ip_col]
    metadata = {
        "extractor": "full_features",
        **{f"include_{g}": options.get(f"include_{g}", True) for g in ("time", "ratios", "stats")},
    }
    return _finish(table, ip_col, names, metadata, remove_correlated, corr_threshold)
