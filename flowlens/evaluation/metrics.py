"""Metrics of predictions, all from small tables of counts.

Labels are counted by (true, predicted) pair and scores by distinct value before anything
else happens, so neither a dominant label nor a dominant score reaches one task as rows.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.errors import FlowlensError
from flowlens.operators.ordering import running_sums
from flowlens.schemas import POSITIVE
from flowlens.session import materialize


# A confusion matrix has the square of this many rows at most.
MOST_LABELS = 1_000


def _zero(numerator, denominator):
    """Quotient, 0 where it is undefined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def label_counts(df: DataFrame, true: str = "y_true", predicted: str = "y_pred", *by: str) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, true: str = "y_true", predicted: str = "y_pred", normalize: bool = False
) -> DataFrame:
    """``(y_true, y_pred, count)`` for every pair of labels, zeros included.

    ``normalize`` adds the share within the true label.
    """
    counts = materialize(label_counts(df, true, predicted), "label-counts")
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    if labels.count() > MOST_LABELS:
        raise FlowlensError(f"more than {MOST_LABELS} labels: a confusion matrix needs categories")
    grid = labels.select(F.col("label").alias("y_true")).crossJoin(
        labels.select(F.col("label").alias("y_pred"))
    )
    full = grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("count")
    )
    if normalize:
        row = F.sum("count").over(W.partitionBy("y_true"))
        full = full.withColumn("share", _zero(F.col("count"), row))
    return full.orderBy("y_true", "y_pred")


def score_counts(df: DataFrame, true: str, score: str, positive) -> DataFrame:
    """``(score, pos, neg)`` per distinct score."""
    hit = F.coalesce(F.col(true) == F.lit(positive), F.lit(False))
    scored = df.filter(F.col(score).isNotNull())
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def _cumulative(df, true, score, positive, ranges=None) -> DataFrame:
    """Score counts with counts at or above each score and the totals."""
    counts = materialize(score_counts(df, true, score, positive), "score-counts")
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    summed = running_sums(counts, "score", {"tp": "pos", "fp": "neg"}, True, ranges)
    return summed.crossJoin(F.broadcast(totals))


def roc_auc(df: DataFrame, true: str = "y_true", score: str = "score", positive=POSITIVE, ranges=None) -> DataFrame:
    """One row ``auc``: rank statistic with ties averaged, null with a single class."""
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return _cumulative(df, true, score, positive, ranges).agg(
        F.try_divide(wins.cast("double"), pairs).alias("auc")
    )


def roc_curve(df: DataFrame, true: str = "y_true", score: str = "score", positive=POSITIVE, ranges=None) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, and the origin at an infinite one."""
    points = _cumulative(df, true, score, positive, ranges).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return points.unionByName(origin)


def pr_curve(df: DataFrame, true: str = "y_true", score: str = "score", positive=POSITIVE, ranges=None) -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score, and the end point (1, 0)."""
    points = _cumulative(df, true, score, positive, ranges).select(
        F.col("score").alias("threshold"),
        _zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")).alias("recall"),
    )
    end = df.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return points.unionByName(end)


def average_precision(df: DataFrame, true: str = "y_true", score: str = "score", positive=POSITIVE, ranges=None) -> DataFrame:
    """One row: precision weighted by the gain in recall."""
    precision = _zero(F.col("tp"), F.col("tp") + F.col("fp"))
    gain = F.try_divide(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    return _cumulative(df, true, score, positive, ranges).agg(
        F.sum(gain * precision).alias("average_precision")
    )


def classification_metrics(
    df: DataFrame,
    true: str = "y_true",
    predicted: str = "y_pred",
    score: str | None = None,
    positive=POSITIVE,
) -> DataFrame:
    """One row: accuracy, precision, recall, F1, specificity (two labels only), AUC (with scores)."""
    counts = label_counts(df, true, predicted)
    n = F.col("n")
    is_true, is_pred = F.col("y_true") == F.lit(positive), F.col("y_pred") == F.lit(positive)
    low = F.min(F.least("y_true", "y_pred"))
    one = counts.agg(
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(0)).alias("right"),
        F.sum(F.when(is_true & is_pred, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~is_true & is_pred, n).otherwise(0)).alias("fp"),
        F.sum(F.when(is_true & ~is_pred, n).otherwise(0)).alias("fn"),
        low.alias("low"),
        # Labels are few: one entry per class.
        F.array_distinct(F.concat(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels"),
        F.collect_list(F.struct("y_true", "y_pred", "n")).alias("cells"),
    )
    first = F.filter("cells", lambda c: c["y_true"] == F.col("low"))
    negatives = F.aggregate(first, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    kept = F.aggregate(
        first,
        F.lit(0).cast("bigint"),
        lambda a, c: a + F.when(c["y_pred"] == F.col("low"), c["n"]).otherwise(0),
    )
    precision = _zero(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _zero(F.col("tp"), F.col("tp") + F.col("fn"))
    row = one.select(
        _zero(F.col("right"), F.col("total")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.when(
            F.size("labels") == 2, F.try_divide(kept.cast("double"), negatives.cast("double"))
        ).alias("specificity"),
    )
    if score is None:
        return row.withColumn("auc", F.lit(None).cast("double"))
    return row.crossJoin(F.broadcast(roc_auc(df, true, score, positive)))


def classification_report(df: DataFrame, true: str = "y_true", predicted: str = "y_pred", *by: str) -> DataFrame:
    """Precision, recall, F1 and support per label, with accuracy, macro and weighted rows; one report for each group of ``by``."""
    counts = label_counts(df, true, predicted, *by)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("y_pred").alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("s"),
        "n",
        (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"),
    )
    per = sides.groupBy(*by, F.col("s.l").cast("string").alias("label")).agg(
        F.sum(F.col("n") * F.col("s.t") * F.col("hit")).alias("tp"),
        F.sum(F.col("n") * F.col("s.t")).alias("support"),
        F.sum(F.col("n") * F.col("s.p")).alias("predicted"),
    )
    per = per.select(
        *by,
        "label",
        _zero(F.col("tp"), F.col("predicted")).alias("precision"),
        _zero(F.col("tp"), F.col("support")).alias("recall"),
        _zero(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )
    measures = ("precision", "recall", "f1")
    whole = F.sum("support")
    one = per.groupBy(*by).agg(
        whole.alias("support"),
        _zero(F.sum("tp"), whole).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_zero(F.sum(F.col(m) * F.col("support")), whole).alias(f"weighted_{m}") for m in measures],
    )
    rows = [
        F.struct(
            F.lit(name).alias("label"), *[F.col(c).alias(m) for c, m in zip(columns, measures)], "support"
        )
        for name, columns in (
            ("accuracy", ("accuracy",) * 3),
            ("macro avg", tuple(f"macro_{m}" for m in measures)),
            ("weighted avg", tuple(f"weighted_{m}" for m in measures)),
        )
    ]
    averages = one.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    return per.drop("tp").unionByName(averages)


def comparison_table(results: dict) -> DataFrame:
    """Metric rows of several models, one per name, in the order given."""
    named = [
        row.select(F.lit(name).alias("model"), F.lit(i).alias("position"), *row.columns)
        for i, (name, row) in enumerate(results.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def best_model(table: DataFrame, metric: str = "accuracy") -> DataFrame:
    """The model with the highest value of a metric, the earliest on ties."""
    if metric not in table.columns:
        raise ValueError(f"metric '{metric}' is not in the table")
    return table.orderBy(F.desc_nulls_last(metric), "position").limit(1).select("model", metric)
