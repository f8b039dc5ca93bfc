"""Cross-validation and model comparison."""

import math
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.evaluation.metrics import (
    classification_metrics,
    classification_report,
    confusion_matrix,
    roc_auc,
)
from flowlens.ml.classify import train
from flowlens.operators.ordering import hash_rank
from flowlens.schemas import POSITIVE, SEED, TARGET
from flowlens.session import materialize

SCORERS = ("accuracy", "precision", "recall", "f1", "roc_auc")
# Fits at a time: each is a row of short jobs, between which the driver plans and executors wait. More cost the driver memory.
FITS = 3


def stratified_folds(df: DataFrame, key: str = "ipsrc", target: str = TARGET, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1: rows of each label are dealt out in hash order of the key."""
    ranked = hash_rank(df, key, target, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def _report_scores(report) -> dict:
    """Accuracy and weighted precision, recall and F1 out of a report's rows; zeros if it has none."""
    found = {r["label"]: r for r in report}
    out = {"accuracy": found["accuracy"]["f1"] if found else 0.0}
    return out | {name: found["weighted avg"][name] if found else 0.0 for name in ("precision", "recall", "f1")}


def _scores(predicted: DataFrame, target: str, positive: str, scoring) -> dict:
    """Weighted precision, recall, F1 and the other scorers of one fold."""
    out = {}
    if set(scoring) - {"roc_auc"}:
        out |= _report_scores(classification_report(predicted, target, "prediction").collect())
    if "roc_auc" in scoring:
        out["roc_auc"] = roc_auc(predicted, target, "probability", positive).first()["auc"]
    return {name: out[name] for name in scoring}


def _side_by_side(spark: SparkSession, run, items) -> list:
    """Results of ``run`` for each item, in their order, ``FITS`` at a time. Each call has Spark properties of its own."""
    calls = [inheritable_thread_target(spark)(partial(run, item)) for item in items]
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(lambda call: call(), calls))


def _fold_predictions(folded: DataFrame, fold: int, model_key: str, *args, **params) -> DataFrame:
    """Predictions for the rows of a fold by a model fitted to all others."""
    fitted = train(folded.filter(F.col("fold") != fold).drop("fold"), model_key, *args, **params)
    return materialize(fitted.predict(folded.filter(F.col("fold") == fold).drop("fold")), "fold-predictions")


def cross_validate(
    df: DataFrame,
    model_key: str,
    features=None,
    target: str = TARGET,
    key: str = "ipsrc",
    k: int = 5,
    scoring=("accuracy",),
    positive: str = POSITIVE,
    scale: bool = False,
    **params,
) -> DataFrame:
    """``(fold, metric, score)``. Scaling and parameters belong to every fold's own fit."""
    folded = materialize(stratified_folds(df, key, target, k), "folds")

    def scored(fold):
        predicted = _fold_predictions(folded, fold, model_key, features, target, key, positive, scale, **params)
        return _scores(predicted, target, positive, scoring)

    found = enumerate(_side_by_side(df.sparkSession, scored, range(k)))
    rows = [(fold, metric, score) for fold, scores in found for metric, score in scores.items()]
    return df.sparkSession.createDataFrame(rows, "fold int, metric string, score double")


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    """``(metric, mean, std)`` over the folds, population deviation."""
    return scores.groupBy("metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )


def evaluate_model(
    df: DataFrame, model_key: str, features=None, target: str = TARGET, key: str = "ipsrc", k: int = 5,
    positive: str = POSITIVE, scale: bool = False, **params,
) -> dict:
    """Metrics on the training rows, their confusion table, and cross-validation."""
    fitted = train(df, model_key, features, target, key, positive, scale, **params)
    predicted = materialize(fitted.predict(df), "resubstitution")
    score = "probability" if "probability" in predicted.columns else None
    scores = cross_validate(
        df, model_key, features, target, key, k, ("accuracy", "precision", "recall", "f1"), positive, scale, **params
    )
    return {
        "resubstitution": classification_metrics(predicted, target, "prediction", score, positive),
        "confusion_matrix": confusion_matrix(predicted, target, "prediction"),
        "cross_validation": cross_validation_summary(scores),
    }


def compare_models(
    df: DataFrame, model_keys, features=None, target: str = TARGET, key: str = "ipsrc", k: int = 5,
    positive: str = POSITIVE, scale: bool = False,
) -> DataFrame:
    """Cross-validated table of several models, most accurate first.

    Folds are dealt out once for all models, and all predictions are counted in one report.
    """
    model_keys = list(model_keys)
    folded = materialize(stratified_folds(df, key, target, k), "folds")
    runs = [(name, fold) for name in model_keys for fold in range(k)]

    def fitted(run):
        return _fold_predictions(folded, run[1], run[0], features, target, key, positive, scale)

    predicted = _side_by_side(df.sparkSession, fitted, runs)
    # Labels of some models are texts.
    labels = F.col(target).cast("string").alias("y_true"), F.col("prediction").cast("string").alias("y_pred")
    sides = [p.select(F.lit(i).alias("run"), *labels) for i, p in enumerate(predicted)]
    reports = {i: [] for i in range(len(runs))}
    for r in classification_report(reduce(DataFrame.unionByName, sides), "y_true", "y_pred", "run").collect() if sides else []:
        reports[r["run"]].append(r)
    by = {}
    for i, (name, _) in enumerate(runs):
        for metric, score in _report_scores(reports[i]).items():
            by.setdefault(name, {}).setdefault(metric, []).append(score)
    rows = []
    for name in model_keys:
        mean = {m: sum(v) / len(v) for m, v in by[name].items()}
        accuracy = by[name]["accuracy"]
        spread = math.sqrt(sum((x - mean["accuracy"]) ** 2 for x in accuracy) / len(accuracy))
        rows.append((name, mean["accuracy"], spread, mean["precision"], mean["recall"], mean["f1"]))
    schema = "model string, accuracy double, accuracy_std double, precision double, recall double, f1 double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("accuracy"), "model")
