"""Joins between flows, feature tables, results and small dimensions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import service_name

RESULT_COLUMNS = ("prediction", "probability", "cluster", "is_anomaly", "anomaly_score")


def join_features(left: DataFrame, right: DataFrame, key: str = "ipsrc") -> DataFrame:
    """Left join of two stored feature tables; both sides shuffle on the key only."""
    return left.join(right, key, "left")


def outer_align(parts: dict, key: str = "ipsrc") -> DataFrame:
    """Aligns per-key counts ``{name: table(key, value)}``, 0 where a key is missing.

    The parts are stacked and summed once, which needs one shuffle however many there are
    (a chain of full joins needs one per part).
    """
    names = list(parts)
    stacked = None
    for name, part in parts.items():
        rows = part.select(
            key, *[(F.col("value") if n == name else F.lit(0)).cast("bigint").alias(n) for n in names]
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])


def attach_results(df: DataFrame, results: DataFrame, key: str = "ipsrc") -> DataFrame:
    """Adds model results by key; rows without a result keep nulls."""
    wanted = [c for c in RESULT_COLUMNS if c in results.columns]
    return df.drop(*wanted).join(results.select(key, *wanted), key, "left")


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values of a column, smallest value first on ties."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), key)
        .limit(n)
        .select(key)
    )


def semi_top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` most frequent (at most ``n`` rows are broadcast)."""
    return df.join(F.broadcast(top_keys(df, key, n)), key, "left_semi")


def port_service(df: DataFrame, column: str = "portdst", output: str = "service") -> DataFrame:
    """Service name per port. The 13-entry dimension is a literal, so nothing is joined."""
    return df.withColumn(output, service_name(F.col(column)))


def fill_hours(counts: DataFrame, values, hour: str = "hour") -> DataFrame:
    """All 24 hours, 0 where missing; ``counts`` holds one row per hour."""
    hours = counts.sparkSession.range(24).select(F.col("id").cast("int").alias(hour))
    return hours.join(counts, hour, "left").na.fill(0, subset=list(values))


def compare_ips(stats: DataFrame, ips, most: int = 5) -> DataFrame:
    """Statistics of a chosen set of at most ``most`` addresses."""
    chosen = list(ips)
    if len(chosen) > most:
        raise ValueError(f"choose at most {most} addresses")
    return stats.filter(F.col("ipsrc").isin(*chosen))
