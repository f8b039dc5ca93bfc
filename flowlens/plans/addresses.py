"""Reports on source addresses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions import floor_time, percent
from flowlens.operators.filters import external_sources, flows_of_ip, min_flows
from flowlens.plans.traffic import _denies, _permits, value_counts
from flowlens.session import materialize

PROFILE_METRICS = ("total_flows", "permits", "denies", "unique_dst_ports", "unique_dst_ips")


def ip_stats(df: DataFrame) -> DataFrame:
    """Per source: flows, permits, denies, distinct destinations, ports, rules, percentages."""
    return (
        df.filter(F.col("ipsrc").isNotNull())
        .groupBy("ipsrc")
        .agg(
            F.count("*").alias("total_flows"),
            _permits().alias("permits"),
            _denies().alias("denies"),
            F.count_distinct(F.col("ipdst")).alias("unique_dst_ips"),
            F.count_distinct(F.col("portdst")).alias("unique_dst_ports"),
            F.count_distinct(F.col("regle")).alias("unique_rules"),
        )
        .withColumns(
            {
                "permit_ratio": percent(F.col("permits"), F.col("total_flows")),
                "deny_ratio": percent(F.col("denies"), F.col("total_flows")),
            }
        )
    )


def top_sources(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        df.filter(F.col("ipsrc").isNotNull())
        .groupBy("ipsrc")
        .agg(
            F.count("*").alias("total_flows"),
            _permits().alias("permits"),
            _denies().alias("denies"),
            F.count_distinct(F.col("portdst")).alias("unique_dst_ports"),
        )
        .orderBy(F.desc("total_flows"), "ipsrc")
        .limit(n)
    )


def top_external_sources(df: DataFrame, sort_by: str = "total_flows", n: int = 20) -> DataFrame:
    """Busiest sources outside the internal prefix, by flows, denies or distinct ports."""
    return (
        external_sources(df)
        .filter(F.col("ipsrc").isNotNull())
        .groupBy("ipsrc")
        .agg(
            F.count("*").alias("total_flows"),
            _permits().alias("permits"),
            _denies().alias("denies"),
            F.count_distinct(F.col("ipdst")).alias("unique_dst_ips"),
            F.count_distinct(F.col("portdst")).alias("unique_ports"),
        )
        .orderBy(F.desc(sort_by), "ipsrc")
        .limit(n)
    )


def busiest_ips(stats: DataFrame, top_n: int = 100, least: int = 1) -> DataFrame:
    return min_flows(stats, least).orderBy(F.desc("total_flows"), "ipsrc").limit(top_n)


def port_scanners(df: DataFrame, top_n: int = 100, least: int = 1, n: int = 10) -> DataFrame:
    """Among the busiest sources, those with most distinct ports per flow."""
    return (
        busiest_ips(ip_stats(df), top_n, least)
        .select(
            "ipsrc",
            "total_flows",
            "unique_dst_ports",
            "denies",
            (F.col("unique_dst_ports") / F.col("total_flows")).alias("scan_score"),
        )
        .orderBy(F.desc("scan_score"), "ipsrc")
        .limit(n)
    )


def ip_list_position(stats: DataFrame, position: int, sort_by: str = "total_flows", most: int = 100) -> DataFrame:
    """The address at a 0-based position of the list of the ``most`` highest by a metric.

    The numbering window runs over at most ``most`` rows.
    """
    top = stats.orderBy(F.desc(sort_by), "ipsrc").limit(most)
    order = W.orderBy(F.desc(sort_by), "ipsrc")
    return top.withColumn("position", F.row_number().over(order) - 1).filter(
        F.col("position") == position
    )


def _breakdown(df: DataFrame, ip: str, column: str, n: int) -> DataFrame:
    return (
        flows_of_ip(df, ip)
        .filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"), _permits().alias("permits"), _denies().alias("denies"))
        .orderBy(F.desc("count"), column)
        .limit(n)
    )


def ip_destinations(df: DataFrame, ip: str, n: int = 20) -> DataFrame:
    return _breakdown(df, ip, "ipdst", n)


def ip_ports(df: DataFrame, ip: str, n: int = 20) -> DataFrame:
    return _breakdown(df, ip, "portdst", n)


def ip_top_ports(df: DataFrame, ip: str, n: int = 10) -> DataFrame:
    return value_counts(flows_of_ip(df, ip), "portdst").limit(n)


def ip_timeline(df: DataFrame, ip: str) -> DataFrame:
    """Hourly flows of one address by action."""
    return (
        flows_of_ip(df, ip)
        .filter(F.col("date").isNotNull() & F.col("action").isNotNull())
        .groupBy(floor_time(F.col("date"), "hour").alias("hour"), "action")
        .agg(F.count("*").alias("count"))
    )


def head_of_ip(df: DataFrame, ip: str, n: int = 100, order=("date", "event_id")) -> DataFrame:
    keys = [c for c in order if c in df.columns]
    return flows_of_ip(df, ip).orderBy(*keys).limit(n)


def profile_scale(df: DataFrame, metrics=PROFILE_METRICS, key: str = "ipsrc") -> DataFrame:
    """Each metric as a percentage of its largest value (unchanged when that is not above 0)."""
    df = materialize(df.select(key, *metrics), "profiles")
    top = df.agg(*[F.max(m).alias(f"_max_{m}") for m in metrics])
    scaled = [
        F.when(F.col(f"_max_{m}") > 0, F.col(m) / F.col(f"_max_{m}") * 100)
        .otherwise(F.col(m).cast("double"))
        .alias(m)
        for m in metrics
    ]
    return df.crossJoin(F.broadcast(top)).select(key, *scaled)
