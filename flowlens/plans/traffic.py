"""Totals, protocol and port reports, and activity over time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import (
    count_where,
    floor_time,
    is_external,
    normalize_protocol,
    percent,
    period_label,
    port_category,
    port_category_rank,
)
from flowlens.operators.joins import fill_hours, semi_top_n
from flowlens.operators.filters import flows_of_day, permitted_well_known
from flowlens.operators.joins import port_service

ACTIONS = ("DENY", "PERMIT")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _permits():
    return count_where(F.col("action") == "PERMIT")


def _denies():
    return count_where(F.col("action") == "DENY")


def _protocol(name):
    return count_where(F.col("proto") == name)


def usage(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Flows per value of ``key`` and their percentage of all flows, rows without a value included in those.

    One pass over the flows: the total, one row, is summed from the same exchange of counts.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("occurrences"))
    total = counts.agg(F.sum("occurrences").alias("_total"))
    # Asked beside the total, the condition stays above the exchange, so that both sides share it.
    shared = counts.crossJoin(F.broadcast(total)).filter(F.when(F.col("_total") > 0, F.col(key).isNotNull()))
    shared = shared.withColumn("pct", percent(F.col("occurrences"), F.col("_total"), digits)).drop("_total")
    return shared.orderBy(F.desc("occurrences"), key)


def overview_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        _permits().alias("permits"),
        _denies().alias("denies"),
        _protocol("TCP").alias("tcp"),
        _protocol("UDP").alias("udp"),
    ).withColumns(
        {
            "permit_pct": F.coalesce(percent(F.col("permits"), F.col("total")), F.lit(0.0)),
            "deny_pct": F.coalesce(percent(F.col("denies"), F.col("total")), F.lit(0.0)),
        }
    )


def summary_metrics(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals and distinct counts; ``approximate`` swaps in sketches."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias("total_flows"),
        distinct(F.col("ipsrc")).alias("unique_src_ips"),
        distinct(F.col("ipdst")).alias("unique_dst_ips"),
        distinct(F.col("portdst")).alias("unique_ports"),
        distinct(F.col("regle")).alias("unique_rules"),
        _permits().alias("permits"),
        _denies().alias("denies"),
        _protocol("TCP").alias("tcp_flows"),
        _protocol("UDP").alias("udp_flows"),
        distinct(F.when(is_external(F.col("ipsrc")), F.col("ipsrc"))).alias("external_src_ips"),
    )


def upload_stats(df: DataFrame, label: str = "risk") -> DataFrame:
    """Row, address and column counts and the DENY percentage of a freshly read table."""
    aggregates = [F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")]
    if "ipsrc" in df.columns:
        aggregates.append(F.count_distinct(F.col("ipsrc")).alias("unique_ips"))
    if "action" in df.columns:
        aggregates.append(percent(_denies(), F.count("*")).alias("deny_rate"))
    if label in df.columns:
        aggregates.append(percent(count_where(F.col(label) == "positive"), F.count("*")).alias("positive_rate"))
    return df.agg(*aggregates)


def quick_stats(df: DataFrame) -> DataFrame:
    """Counts of the currently filtered rows; 'other' is everything not permitted."""
    return df.agg(
        F.count("*").alias("records"),
        F.count_distinct(F.col("ipsrc")).alias("unique_ips"),
        F.count_distinct(F.col("portdst")).alias("unique_ports"),
        _permits().alias("permits"),
        (F.count("*") - _permits()).alias("others"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of a column's non-null values, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def proto_action_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("proto").isNotNull() & F.col("action").isNotNull())
        .groupBy("proto", "action")
        .agg(F.count("*").alias("count"))
    )


def _action_columns(actions):
    return [count_where(F.col("action") == a).alias(a) for a in actions]


def proto_action_pivot(df: DataFrame, actions=ACTIONS) -> DataFrame:
    """One row per protocol, one column per action, the total and the PERMIT percentage."""
    return (
        df.filter(F.col("proto").isNotNull() & F.col("action").isNotNull())
        .groupBy("proto")
        .agg(*_action_columns(actions), F.count("*").alias("Total"))
        .withColumn("permit_pct", percent(F.col("PERMIT"), F.col("Total")))
    )


def with_port_category(df: DataFrame, zero_is_known: bool = True) -> DataFrame:
    return df.withColumn("port_category", port_category(F.col("portdst"), zero_is_known))


def port_range_pivot(df: DataFrame, actions=ACTIONS) -> DataFrame:
    """Port range by action with totals and both percentages, 'Unknown' last."""
    return (
        with_port_category(df)
        .filter(F.col("action").isNotNull())
        .groupBy("port_category")
        .agg(*_action_columns(actions), F.count("*").alias("Total"))
        .withColumns(
            {
                "permit_pct": percent(F.col("PERMIT"), F.col("Total")),
                "deny_pct": percent(F.col("DENY"), F.col("Total")),
            }
        )
        .orderBy(port_category_rank(F.col("port_category")))
    )


def port_range_counts(df: DataFrame) -> DataFrame:
    """Flows per port range; port 0 and missing ports fall outside all ranges."""
    ranged = with_port_category(df, zero_is_known=False).filter(F.col("port_category") != "Unknown")
    return value_counts(ranged, "port_category")


def flow_hierarchy(df: DataFrame) -> DataFrame:
    """proto > action > port range with subtotals; ``level`` 0 is the grand total.

    Flows are counted once at the finest level; the rollup runs over that small table.
    """
    leaves = (
        with_port_category(df)
        .filter(F.col("proto").isNotNull() & F.col("action").isNotNull())
        .groupBy("proto", "action", "port_category")
        .agg(F.count("*").alias("n"))
    )
    level = 3 - F.grouping("proto") - F.grouping("action") - F.grouping("port_category")
    return leaves.rollup("proto", "action", "port_category").agg(
        level.cast("int").alias("level"), F.sum("n").alias("count")
    )


def protocol_usage(df: DataFrame) -> DataFrame:
    """Flows and share per normalised protocol."""
    return usage(df.select(normalize_protocol(F.col("proto")).alias("protocol")), "protocol")


def interface_stats(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("interface_in").isNotNull())
        .groupBy("interface_in")
        .agg(F.count("*").alias("total"), _permits().alias("permits"), _denies().alias("denies"))
    )


def traffic_over_time(df: DataFrame, unit: str = "day") -> DataFrame:
    """Flows per hour / day / week / month and action, with a text label per period."""
    return (
        df.filter(F.col("date").isNotNull() & F.col("action").isNotNull())
        .groupBy(floor_time(F.col("date"), unit).alias("period"), "action")
        .agg(F.count("*").alias("count"))
        .select("period", period_label(F.col("period"), unit).alias("label"), "action", "count")
    )


def hour_of_day(df: DataFrame, actions=ACTIONS) -> DataFrame:
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(F.hour("date").alias("hour"))
        .agg(*_action_columns(actions))
        .orderBy("hour")
    )


def activity_heatmap(df: DataFrame) -> DataFrame:
    """One row per weekday present (Monday first), one zero-filled column per hour.

    Flows are counted per weekday and hour; only those 168 counts are spread into columns.
    """
    counts = (
        df.filter(F.col("date").isNotNull())
        .groupBy(F.weekday("date").alias("weekday"), F.hour("date").alias("hour"))
        .agg(F.count("*").alias("n"))
    )
    hours = [
        F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)).alias(f"h{h:02d}") for h in range(24)
    ]
    name = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1)
    return (
        counts.groupBy("weekday")
        .agg(*hours)
        .select("weekday", name.alias("day_name"), *[f"h{h:02d}" for h in range(24)])
        .orderBy("weekday")
    )


def spike_day_hours(df: DataFrame, day: str, actions=ACTIONS) -> DataFrame:
    """24 rows of one day's flows by action."""
    counts = (
        flows_of_day(df, day).groupBy(F.hour("date").alias("hour")).agg(*_action_columns(actions))
    )
    return fill_hours(counts, actions).orderBy("hour")


def spike_day_totals(df: DataFrame, day: str) -> DataFrame:
    return value_counts(flows_of_day(df, day), "action")


def spike_day_top(df: DataFrame, day: str, column: str, n: int = 10) -> DataFrame:
    """Most denied sources or ports of one day."""
    denied = flows_of_day(df, day).filter(F.col("action") == "DENY")
    return value_counts(denied, column).limit(n).withColumnRenamed("count", "denies")


def busiest_deny_days(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(F.to_date("date").alias("day"))
        .agg(F.count("*").alias("total"), _denies().alias("denies"), _permits().alias("permits"))
        .orderBy(F.desc("denies"), "day")
        .limit(n)
    )


def top_permitted_ports(df: DataFrame, n: int = 10) -> DataFrame:
    """Busiest permitted ports below 1024, their distinct sources and service names."""
    top = (
        permitted_well_known(df)
        .groupBy("portdst")
        .agg(F.count("*").alias("count"), F.count_distinct(F.col("ipsrc")).alias("unique_src_ips"))
        .orderBy(F.desc("count"), "portdst")
        .limit(n)
    )
    return port_service(top)


def top_well_known_ports(df: DataFrame, n: int = 20) -> DataFrame:
    return value_counts(df.filter(F.col("portdst") < 1024), "portdst").limit(n)


def top_ports(df: DataFrame, n: int = 20) -> DataFrame:
    """The busiest destination ports split by action, ordered by their total."""
    pairs = (
        df.filter(F.col("portdst").isNotNull() & F.col("action").isNotNull())
        .groupBy("portdst", "action")
        .agg(F.count("*").alias("count"))
    )
    totals = (
        pairs.groupBy("portdst")
        .agg(F.sum("count").alias("total"))
        .orderBy(F.desc("total"), "portdst")
        .limit(n)
    )
    # At most n rows are broadcast.
    return pairs.join(F.broadcast(totals), "portdst").orderBy(F.desc("total"), "portdst", "action")


def top_port_flows(df: DataFrame, n: int = 20) -> DataFrame:
    """All flows towards the ``n`` busiest ports."""
    return semi_top_n(df, "portdst", n)
