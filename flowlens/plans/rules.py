"""Reports on firewall rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import count_where
from flowlens.operators.columns import with_protocol
from flowlens.plans.traffic import _denies, _permits, usage, value_counts
from flowlens.session import materialize


def rule_usage(df: DataFrame) -> DataFrame:
    """Flows per rule and their share of all flows."""
    return usage(df, "regle")


def top_rules(df: DataFrame, n: int = 10) -> DataFrame:
    """Busiest rules; PERMIT dominates only when strictly more frequent."""
    return (
        df.filter(F.col("regle").isNotNull())
        .groupBy("regle")
        .agg(F.count("*").alias("total"), _permits().alias("permits"), _denies().alias("denies"))
        .orderBy(F.desc("total"), "regle")
        .limit(n)
        .withColumn(
            "dominant_action",
            F.when(F.col("permits") > F.col("denies"), "PERMIT").otherwise("DENY"),
        )
    )


def top_rules_by_protocol(df: DataFrame, protocol: str, n: int = 10) -> DataFrame:
    chosen = with_protocol(df).filter(F.col("proto_norm") == protocol)
    return value_counts(chosen, "regle").limit(n)


def rule_port_action(df: DataFrame, protocol: str = "TCP", n: int = 30) -> DataFrame:
    """Rule and port pairs of one protocol by action, busiest first."""
    return (
        with_protocol(df)
        .filter(F.col("proto_norm") == protocol)
        .filter(F.col("regle").isNotNull() & F.col("portdst").isNotNull() & F.col("action").isNotNull())
        .groupBy("regle", "portdst")
        .agg(
            count_where(F.col("action") == "DENY").alias("DENY"),
            count_where(F.col("action") == "PERMIT").alias("PERMIT"),
        )
        .withColumn("Total", F.col("DENY") + F.col("PERMIT"))
        .orderBy(F.desc("Total"), "regle", "portdst")
        .limit(n)
    )


def rule_port_matrix(df: DataFrame, n_rules: int = 10, n_ports: int = 10) -> DataFrame:
    """Flows between the busiest rules and the busiest ports, long form, zeros left out.

    The flows are counted by rule and port once; both top lists come from those counts.
    """
    whole = counts = materialize(df.groupBy("regle", "portdst").agg(F.count("*").alias("count")), "rule-ports")
    for key, n in (("regle", n_rules), ("portdst", n_ports)):
        totals = whole.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("count").alias("_n"))
        busiest = totals.orderBy(F.desc("_n"), key).limit(n).select(key)
        counts = counts.join(F.broadcast(busiest), key, "left_semi")
    return counts


def ip_rules(flows_of_one_ip: DataFrame, n: int = 10) -> DataFrame:
    """Rules hit, with the most frequent action (smallest on ties), 'N/A' without any.

    Counted per (rule, action) first, so the mode is taken over that small table.
    """
    pairs = (
        flows_of_one_ip.filter(F.col("regle").isNotNull())
        .groupBy("regle", "action")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.when(F.col("action").isNotNull(), F.struct((-F.col("n")).alias("n"), "action")))
    return (
        pairs.groupBy("regle")
        .agg(F.sum("n").alias("count"), F.coalesce(best["action"], F.lit("N/A")).alias("action"))
        .orderBy(F.desc("count"), "regle")
        .limit(n)
    )
