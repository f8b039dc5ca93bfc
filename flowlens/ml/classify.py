"""Supervised models: a registry of classifiers, training, prediction, importances."""

from dataclasses import dataclass, field

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.errors import ModelError
from flowlens.ml.exact_tree import ExactTree, fit_exact_tree
from flowlens.ml.kernels import COMPONENTS, LandmarkMap, fit_landmarks, scale_gamma
from flowlens.ml.knn import KNNModel
from flowlens.operators.columns import numeric_columns
from flowlens.operators.preparation import Scaler, encode_label, fit_scaler
from flowlens.schemas import POSITIVE, SEED, TARGET
from flowlens.session import materialize

# Spark's deepest tree.
UNLIMITED_DEPTH = 30


def _tree(rows, max_depth=None, min_samples_leaf=1, **_):
    return DecisionTreeClassifier(
        maxDepth=max_depth or UNLIMITED_DEPTH, minInstancesPerNode=min_samples_leaf, seed=SEED
    )


def _logistic(rows, C=1.0, max_iter=500, **_):
    # The penalty is per row here, so it is divided by the number of rows.
    return LogisticRegression(regParam=1.0 / (C * rows), elasticNetParam=0.0, maxIter=max_iter, standardization=False)


def _forest(rows, n_estimators=100, max_depth=None, **_):
    return RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth or UNLIMITED_DEPTH, seed=SEED)


def _boosting(rows, n_estimators=100, learning_rate=0.1, max_depth=3, **_):
    return GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, seed=SEED)


def _svm(rows, C=1.0, **_):
    return LinearSVC(regParam=1.0 / (C * rows), standardization=False, tol=1e-4)


CLASSIFIERS = {
    "decision_tree": _tree,
    "logistic_regression": _logistic,
    "random_forest": _forest,
    "gradient_boosting": _boosting,
    "svm": _svm,
    "knn": None,
}


def register_classifier(name: str, factory) -> None:
    """Adds ``factory(rows, **params)`` returning a Spark ML classifier."""
    CLASSIFIERS[name] = factory


@dataclass
class OnlyLabel:
    """Stands for a model that Spark fits to two labels only, where the training rows have one."""


@dataclass
class TrainedClassifier:
    """A fitted classifier with everything needed to apply it."""

    model_key: str
    model: object
    features: list
    target: str
    key: str
    labels: list
    positive: str
    scaler: Scaler | None = None
    landmarks: LandmarkMap | None = None
    calibration: object = None
    params: dict = field(default_factory=dict)

    def _scaled(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df) if self.scaler else df

    def _vectors(self, df: DataFrame) -> DataFrame:
        return _assemble(df, self.features, self.scaler, self.landmarks)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and the ``probability`` of the positive label.

        If the training rows had one label, all rows get it, and another positive label has probability 0.
        """
        if isinstance(self.model, KNNModel):
            found = self.model.predict(self._scaled(df), self.positive)
            return df.join(found.select(self.key, "prediction", "probability"), self.key)
        if isinstance(self.model, ExactTree):
            return self._tree_predictions(df)
        if isinstance(self.model, OnlyLabel):
            sure = F.lit(float(self.positive in self.labels))
            return self._vectors(df).select(
                *[F.col(c) for c in df.columns], F.lit(self.labels[0]).alias("prediction"), sure.alias("probability")
            )
        scored = self.model.transform(self._vectors(df))
        label = F.element_at(
            F.array(*[F.lit(x) for x in self.labels]), F.col("_prediction").cast("int") + 1
        )
        if self.calibration is not None:
            scored = scored.withColumn("_margin", array_to_vector(F.slice(vector_to_array("_raw"), 2, 1)))
            scored = self.calibration.transform(scored)
        return self._with_probability(scored, df.columns, label, vector_to_array("_probability"))

    def _with_probability(self, scored: DataFrame, names, label, shares) -> DataFrame:
        columns = [F.col(c) for c in names] + [label.alias("prediction")]
        if self.positive in self.labels:
            columns.append(shares[self.labels.index(self.positive)].alias("probability"))
        elif len(self.labels) == 1:
            columns.append(F.lit(0.0).alias("probability"))
        return scored.select(*columns)

    def _tree_predictions(self, df: DataFrame) -> DataFrame:
        vec = _vector(self.features, self.scaler)
        scored = df.filter(~F.exists(vec, lambda x: x.isNull() | F.isnan(x))).withColumn("_shares", self.model.shares(df.sparkSession, vec))
        names = F.array(*[F.lit(x) for x in self.labels])
        label = F.element_at(names, F.array_position("_shares", F.array_max("_shares")).cast("int"))
        return self._with_probability(scored, df.columns, label, F.col("_shares"))

    def feature_importance(self, n: int | None = None) -> DataFrame:
        """``(feature, importance)``, largest first; coefficients count by size."""
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        elif self.landmarks is None and hasattr(self.model, "coefficients"):
            values = abs(self.model.coefficients.toArray())
        else:
            raise ModelError(f"model {self.model_key} has no feature importance")
        spark = SparkSession.getActiveSession()
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        table = spark.createDataFrame(rows, "feature string, importance double")
        table = table.orderBy(F.desc("importance"), "feature")
        return table.limit(n) if n else table

    def rules(self) -> str:
        """Text rules of a tree model, with feature names."""
        if not hasattr(self.model, "toDebugString"):
            raise ModelError(f"model {self.model_key} has no rules")
        text = self.model.toDebugString
        for i in reversed(range(len(self.features))):
            text = text.replace(f"feature {i} ", f"{self.features[i]} ")
        return text

    def leaf_count(self) -> int:
        return (self.model.numNodes + 1) // 2


def _vector(features, scaler):
    """Array of the scaled features."""
    return F.array(*[(F.col(f) - scaler.shift[f]) / scaler.scale[f] if scaler else F.col(f).cast("double") for f in features])


def _assemble(df, features, scaler, landmarks) -> DataFrame:
    """Adds ``_features``; the original columns stay unscaled."""
    names = [f"_f{i}" for i in range(len(features))]
    columns = {
        n: (F.col(f) - scaler.shift[f]) / scaler.scale[f] if scaler else F.col(f).cast("double")
        for n, f in zip(names, features)
    }
    wide = df.withColumns(columns)
    if landmarks is not None:
        whole = wide.na.drop(subset=names)
        mapped = array_to_vector(landmarks.column(F.array(*names)))
        return whole.withColumn("_features", mapped).drop(*names)
    assembler = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="skip")
    return assembler.transform(wide).drop(*names)


def train(
    df: DataFrame,
    model_key: str,
    features=None,
    target: str = TARGET,
    key: str = "ipsrc",
    positive: str = POSITIVE,
    scale: bool = False,
    **params,
) -> TrainedClassifier:
    """Fits a registered classifier on a labelled table.

    A ``decision_tree`` looks at every distinct value if ``exact`` is set or ``min_samples_split`` is given; else at
    Spark's 32 bins of each feature.
    """
    if model_key not in CLASSIFIERS:
        raise ModelError(f"unknown classifier: {model_key}")
    features = list(features or numeric_columns(df, exclude=(target, key)))
    scaler = fit_scaler(df, features) if scale else None
    if model_key == "knn":
        table = (scaler.transform(df) if scaler else df).select(key, *features, target)
        model = KNNModel(
            table, features, target, key, params.get("n_neighbors", 5), params.get("weights", "uniform")
        )
        labels = sorted(r[0] for r in df.select(target).distinct().collect())
        return TrainedClassifier(model_key, model, features, target, key, labels, positive, scaler, params=params)
    encoded, indexer = encode_label(df, target, "_label")
    if model_key == "decision_tree" and (params.get("exact") or "min_samples_split" in params):
        rows = encoded.select(_vector(features, scaler).alias("vec"), F.col("_label").alias("label"))
        limits = {name: params[name] for name in ("max_depth", "min_samples_split", "min_samples_leaf") if name in params}
        model = fit_exact_tree(rows, features, len(indexer.labels), **limits)
        return TrainedClassifier(model_key, model, features, target, key, list(indexer.labels), positive, scaler, params=params)
    if model_key == "svm" and len(indexer.labels) == 1:
        return TrainedClassifier(model_key, OnlyLabel(), features, target, key, list(indexer.labels), positive, scaler, params=params)
    landmarks = None
    if model_key == "svm" and params.get("kernel", "rbf") == "rbf":
        scaled = (scaler.transform(df) if scaler else df).na.drop(subset=features)
        vectors = scaled.select(F.array(*[F.col(f).cast("double") for f in features]).alias("vec"))
        gamma = params.get("gamma") or scale_gamma(vectors, len(features))
        landmarks = fit_landmarks(materialize(vectors, "kernel-rows"), gamma, params.get("components", COMPONENTS))
    vectors = _assemble(encoded, features, scaler, landmarks).select("_features", "_label")
    # Read by every iteration of the fit.
    vectors = materialize(vectors, "training")
    rows = vectors.count()
    estimator = CLASSIFIERS[model_key](rows, **params)
    estimator.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_prediction")
    for setter, column in (("setProbabilityCol", "_probability"), ("setRawPredictionCol", "_raw")):
        if hasattr(estimator, setter):
            getattr(estimator, setter)(column)
    model = estimator.fit(vectors)
    calibration = None
    if not hasattr(model, "setProbabilityCol"):
        margins = model.transform(vectors).select(
            array_to_vector(F.slice(vector_to_array("_raw"), 2, 1)).alias("_margin"), "_label"
        )
        calibration = LogisticRegression(
            featuresCol="_margin", labelCol="_label", predictionCol="_calibrated",
            probabilityCol="_probability", rawPredictionCol="_raw_calibrated",
        ).fit(margins)
    return TrainedClassifier(
        model_key, model, features, target, key, list(indexer.labels), positive, scaler, landmarks, calibration, params
    )


def predict(model: TrainedClassifier, df: DataFrame) -> DataFrame:
    """Predictions in order of falling probability (by key when there is none)."""
    found = model.predict(df)
    order = [F.desc("probability")] if "probability" in found.columns else []
    return found.orderBy(*order, model.key)
