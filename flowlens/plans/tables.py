"""Descriptive statistics and paging of any table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import percent
from flowlens.operators.columns import numeric_columns
from flowlens.operators.ordering import exact_quantiles
from flowlens.session import scratch_path

QUARTILES = (0.25, 0.5, 0.75)
# Rows of a range of a page directory, and its most ranges; beyond them ranges grow with the table.
RANGE_ROWS = 100_000
MOST_RANGES = 10_000


def describe(df: DataFrame, columns=None, approximate: bool = False) -> DataFrame:
    """One row per numeric column: count, mean, deviation, min, quartiles, max.

    Quartiles are exact unless ``approximate``; they are found by rank brackets, never by
    holding a column in one aggregation buffer. Two passes over the table.
    """
    columns = list(columns or numeric_columns(df))
    moments = {"mean": F.avg, "std": F.stddev_samp}
    if approximate:
        aggregates = {"n": F.count, **moments, "lo": F.min, "hi": F.max}
        row = df.agg(
            *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in aggregates.items()],
            *[F.percentile_approx(F.col(c).cast("double"), list(QUARTILES)).alias(f"q{i}") for i, c in enumerate(columns)],
        ).first()
        quartiles = {c: row[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}
    else:
        quartiles, row = exact_quantiles(
            df, columns, QUARTILES, lambda column: {n: f(column) for n, f in moments.items()}
        )
    rows = [
        (c, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"lo{i}"], *quartiles[c], row[f"hi{i}"])
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )


def describe_values(df: DataFrame, columns) -> DataFrame:
    """Per column as text: non-null count, distinct values, most frequent value, its count."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("x"))
        .filter(F.col("x.value").isNotNull())
        .groupBy("x.column_name", "x.value")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        best["value"].alias("top"),
        (-best["n"]).alias("freq"),
    )


def feature_medians(df: DataFrame, features=None) -> DataFrame:
    """One row ``(feature, median)`` per feature."""
    features = list(features or numeric_columns(df))
    medians = exact_quantiles(df, features, [0.5])
    rows = [(f, medians[f][0]) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, median double")


def feature_histogram(df: DataFrame, feature: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value, per label if given."""
    value = F.col(feature).cast("double")
    limits = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    position = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor(F.try_divide(value - F.col("_lo"), width)).cast("int"))
    )
    keys = [by] if by else []
    return (
        df.filter(value.isNotNull())
        .crossJoin(F.broadcast(limits))
        .groupBy(
            *keys,
            position.cast("int").alias("bin"),
            (F.col("_lo") + width * position).alias("bin_start"),
        )
        .agg(F.count("*").alias("count"))
    )


def feature_box(df: DataFrame, features) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 quartile ranges) per feature."""
    features = list(features)
    quartiles = exact_quantiles(df, features, QUARTILES)
    rows = []
    ends = []
    for i, f in enumerate(features):
        q1, q2, q3 = quartiles[f]
        value = F.col(f).cast("double")
        reach = 1.5 * ((q3 or 0.0) - (q1 or 0.0))
        ends += [
            F.min(F.when(value >= (q1 or 0.0) - reach, value)).alias(f"lo{i}"),
            F.max(F.when(value <= (q3 or 0.0) + reach, value)).alias(f"hi{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"lo{i}").alias("whisker_low"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(q2).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"),
                F.col(f"hi{i}").alias("whisker_high"),
            )
        )
    return df.agg(*ends).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cluster_sizes(df: DataFrame, column: str = "cluster") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def cluster_stats(df: DataFrame, features, column: str = "cluster") -> DataFrame:
    """Mean and sample deviation of each feature per cluster."""
    aggregates = []
    for f in features:
        value = F.col(f).cast("double")
        aggregates += [F.avg(value).alias(f"{f}_mean"), F.stddev_samp(value).alias(f"{f}_std")]
    return df.groupBy(column).agg(*aggregates)


def anomaly_summary(df: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("is_anomaly"))
    return df.agg(
        F.count("*").alias("total"),
        flagged.alias("anomalies"),
        (F.count("*") - flagged).alias("normal"),
        percent(flagged, F.count("*"), 2).alias("anomaly_rate"),
    )


def prediction_summary(df: DataFrame, positive: str = "positive") -> DataFrame:
    hits = F.count_if(F.col("prediction") == positive)
    return df.agg(
        hits.alias("positives"),
        F.count("*").alias("total"),
        percent(hits, F.count("*"), 2).alias("positive_rate"),
    )


def feature_totals(df: DataFrame, key: str = "ipsrc", positive: str = "positive") -> DataFrame:
    """Feature count, total flows, total denies and predicted threats of a feature table."""
    skip = {"prediction", "probability", "cluster", "is_anomaly", "anomaly_score"}
    features = numeric_columns(df, exclude=skip)
    threats = F.count_if(F.col("prediction") == positive) if "prediction" in df.columns else F.lit(0)
    return df.agg(
        F.count("*").alias("n_ips"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.sum("total_flows").alias("total_flows"),
        F.sum("deny").alias("total_denies"),
        threats.cast("bigint").alias("threats"),
    )


def top_by(df: DataFrame, column: str, n: int = 20, key: str = "ipsrc") -> DataFrame:
    return df.orderBy(F.desc(column), key).limit(n)


def top_anomalies(df: DataFrame, n: int = 20, key: str = "ipsrc") -> DataFrame:
    """Most anomalous rows first (a score of 1 is the most anomalous)."""
    return top_by(df, "anomaly_score", n, key)


def top_predictions(df: DataFrame, n: int = 20, key: str = "ipsrc") -> DataFrame:
    return top_by(df, "probability", n, key)


def browse_page(df: DataFrame, sort_by: str, key: str, page: int = 1, rows_per_page: int = 50, ascending: bool = True) -> DataFrame:
    """One page in the order of a column, nulls last, ties by key."""
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return df.orderBy(order, key).offset((page - 1) * rows_per_page).limit(rows_per_page)


def browse_after(df: DataFrame, sort_by: str, key: str, last_value, last_key, rows_per_page: int = 50) -> DataFrame:
    """The page after a known last row: a filter instead of an offset, for deep pages."""
    value, last = F.col(sort_by), F.lit(last_value)
    if last_value is None:
        later = value.isNull() & (F.col(key) > last_key)
    else:
        later = (value > last) | ((value == last) & (F.col(key) > last_key)) | value.isNull()
    return df.filter(later).orderBy(F.asc_nulls_last(sort_by), key).limit(rows_per_page)


@dataclass
class PageDirectory:
    """A table stored in ranges of its order, and the number of rows of each range: pages at any depth without a scan.

    A page reads the one or two ranges it lies in, so no task sees more rows than these hold, wherever the page is.
    """

    table: DataFrame
    rows: list
    order: list
    rows_per_page: int
    range_column: str = "_range"

    @property
    def pages(self) -> int:
        return max(1, -(-sum(self.rows) // self.rows_per_page))

    def ranges_of(self, page: int) -> tuple[list, int]:
        """Numbers of the ranges a page lies in, and how many rows of them come before it."""
        first, end = (page - 1) * self.rows_per_page, page * self.rows_per_page
        found, before, skipped = [], 0, 0
        for i, n in enumerate(self.rows):
            if n and before < end and before + n > first:
                skipped = skipped if found else first - before
                found.append(i)
            before += n
        return found, skipped

    def page(self, page: int) -> DataFrame:
        """Rows of a page in order; none beyond the last page or before the first."""
        found, skipped = self.ranges_of(page) if page > 0 else ([], 0)
        rows = self.table.filter(F.col(self.range_column).isin(found) if found else F.lit(False)).drop(self.range_column)
        return rows.orderBy(*self.order).offset(skipped).limit(self.rows_per_page)


def page_directory(
    df: DataFrame, sort_by: str, key: str, rows_per_page: int = 50, ascending: bool = True, ranges: int | None = None
) -> PageDirectory:
    """Stores ``df`` in ranges of its order (a column, nulls last, ties by key), a folder each.

    The driver keeps one number a range, of which there are at most ``MOST_RANGES``. A page longer than a range
    reads as many as it needs.
    """
    order = [F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by), F.asc(key)]
    ranges = min(ranges or max(1, -(-df.count() // RANGE_ROWS)), MOST_RANGES)
    name = "_range"
    while name in df.columns:
        name += "_"
    placed = df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id())
    path = scratch_path(df.sparkSession, "pages")
    placed.write.partitionBy(name).parquet(path)
    table = df.sparkSession.read.schema(placed.schema).parquet(path)
    counted = dict(map(tuple, table.groupBy(name).count().collect()))
    return PageDirectory(table, [counted.get(i, 0) for i in range(ranges)], order, rows_per_page, name)


def total_pages(df: DataFrame, rows_per_page: int = 50) -> DataFrame:
    rows = F.count("*")
    pages = F.greatest(F.lit(1), F.ceil(rows / rows_per_page)).cast("bigint")
    return df.agg(rows.alias("total_rows"), pages.alias("total_pages"))


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(key).limit(n)
