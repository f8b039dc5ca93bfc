"""Fit and apply anomaly detectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.errors import ModelError
from flowlens.ml.iforest import fit_isolation_forest
from flowlens.ml.kernels import fit_one_class_svm
from flowlens.ml.lof import LocalOutlierFactor, fit_lof
from flowlens.operators.columns import numeric_columns
from flowlens.session import materialize

DETECTORS = {
    "isolation_forest": fit_isolation_forest,
    "one_class_svm": fit_one_class_svm,
    "local_outlier_factor": fit_lof,
}
WITHOUT_CONTAMINATION = ("one_class_svm",)


def register_detector(name: str, fit) -> None:
    """Adds ``fit(df, features, key, **params)`` returning a model with ``score`` and ``threshold``."""
    DETECTORS[name] = fit


def scale_scores(df: DataFrame, scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Adds ``is_anomaly`` and ``anomaly_score`` in [0, 1], 1 being the most anomalous.

    Scores are scaled between the extremes of the table; equal scores give 0.
    """
    scores = materialize(scores, "anomaly-scores")
    limits = scores.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    # One row is broadcast.
    scaled = scores.crossJoin(F.broadcast(limits)).select(
        key,
        (F.col("raw") < threshold).alias("is_anomaly"),
        F.coalesce(
            F.try_divide(F.col("_hi") - F.col("raw"), F.col("_hi") - F.col("_lo")), F.lit(0.0)
        ).alias("anomaly_score"),
    )
    return df.join(scaled, key)


def detect_anomalies(
    df: DataFrame,
    features=None,
    key: str = "ipsrc",
    contamination: float = 0.1,
    model_key: str = "isolation_forest",
    **params,
):
    """Fits a detector and scores its training rows; returns the table and the detector."""
    if model_key not in DETECTORS:
        raise ModelError(f"unknown detector: {model_key}")
    features = features or numeric_columns(df)
    if model_key not in WITHOUT_CONTAMINATION:
        params["contamination"] = contamination
    model = DETECTORS[model_key](df, features, key, **params)
    return scale_scores(df, model.training_scores, key, model.threshold), model


def apply_anomaly_detector(model, df: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Scores a table with a fitted detector."""
    if isinstance(model, LocalOutlierFactor):
        scores = model.score(df, exclude_self)
    else:
        scores = model.score(df)
    return scale_scores(df, scores, model.key, model.threshold)
