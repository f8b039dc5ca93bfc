"""Row filters. All are plain predicates, so they reach the Parquet scan."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import is_external, port_category
from flowlens.schemas import INTERNAL_PREFIX

SEARCH_COLUMNS = ("ipsrc", "ipdst", "portdst", "regle")


def _ntz(value):
    return F.lit(value).cast("timestamp_ntz")


def filter_period_inclusive(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """``start <= t <= end``; a bare end date means its midnight."""
    return df.filter(F.col(column).between(_ntz(start), _ntz(end)))


def filter_dates(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """Whole calendar days, both ends included, as a half-open time range."""
    last = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col(column) >= _ntz(start)) & (F.col(column) < last))


def filter_period(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """``start <= t < end``."""
    return df.filter((F.col(column) >= _ntz(start)) & (F.col(column) < _ntz(end)))


def flows_of_day(df: DataFrame, day: str, column: str = "date") -> DataFrame:
    return filter_dates(df, day, day, column)


def filter_equals(df: DataFrame, everything: str = "All", **wanted) -> DataFrame:
    """Equality per column; ``everything`` (or None) leaves a column unfiltered."""
    for column, value in wanted.items():
        if value is not None and value != everything:
            df = df.filter(F.col(column) == value)
    return df


def filter_in(df: DataFrame, proto=None, action=None, port_categories=None) -> DataFrame:
    """Conjunction of value lists; None leaves a list out."""
    if proto is not None:
        df = df.filter(F.col("proto").isin(*proto))
    if action is not None:
        df = df.filter(F.col("action").isin(*action))
    if port_categories is not None:
        df = df.filter(port_category(F.col("portdst")).isin(*port_categories))
    return df


def filter_port_range(df: DataFrame, low: int = 0, high: int = 65535, column: str = "portdst") -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def search(df: DataFrame, term: str, column: str | None = None) -> DataFrame:
    """Case-insensitive pattern in one column, or in any of the key columns."""
    columns = [column] if column else [c for c in SEARCH_COLUMNS if c in df.columns]
    hits = [
        F.coalesce(F.col(c).cast("string").rlike(f"(?i){term}"), F.lit(False)) for c in columns
    ]
    return df.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


def external_sources(df: DataFrame, prefix: str = INTERNAL_PREFIX) -> DataFrame:
    return df.filter(is_external(F.col("ipsrc"), prefix))


def external_destinations(df: DataFrame, prefix: str = INTERNAL_PREFIX) -> DataFrame:
    return df.filter(is_external(F.col("ipdst"), prefix))


def flows_of_ip(df: DataFrame, ip: str) -> DataFrame:
    return df.filter(F.col("ipsrc") == ip)


def min_flows(stats: DataFrame, least: int) -> DataFrame:
    return stats.filter(F.col("total_flows") >= least)


def permitted_well_known(df: DataFrame) -> DataFrame:
    return df.filter((F.col("portdst") < 1024) & (F.col("action") == "PERMIT"))


def drop_null_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns) or None)


def exclude_dominant(df: DataFrame, port: int = 443) -> DataFrame:
    """Without the rule of the busiest (rule, port) pair and without one port.

    Rows whose rule or port is missing stay.
    """
    dominant = (
        df.filter(F.col("regle").isNotNull() & F.col("portdst").isNotNull())
        .filter(F.col("action").isin("PERMIT", "DENY"))
        .groupBy("regle", "portdst")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "regle", "portdst")
        .limit(1)
        .select(F.col("regle").alias("_rule"))
    )
    kept = df.filter(F.coalesce(F.col("portdst") != port, F.lit(True)))
    return kept.join(F.broadcast(dominant), F.col("regle") == F.col("_rule"), "left_anti")


def filter_options(df: DataFrame, columns=("proto", "action", "regle", "interface_in")) -> DataFrame:
    """Sorted distinct values per filter column, as text, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
            if c in df.columns
        ]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("column_name", "value")
    )
