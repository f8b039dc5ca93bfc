"""Saved models: Spark's own format or Parquet tables, with a JSON description beside them."""

import json

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import SparkSession

from flowlens.errors import ModelError
from flowlens.ml.classify import OnlyLabel, TrainedClassifier
from flowlens.ml.clustering import KMeansClusterer
from flowlens.ml.exact_tree import ExactTree
from flowlens.ml.iforest import NODE_SCHEMA, IsolationForest
from flowlens.ml.kernels import LandmarkMap, OneClassSVM
from flowlens.ml.knn import KNNModel
from flowlens.ml.lof import LocalOutlierFactor
from flowlens.operators.preparation import Scaler
from flowlens.sinks.feature_store import list_feature_sets

SPARK_MODELS = {
    "decision_tree": DecisionTreeClassificationModel,
    "logistic_regression": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "gradient_boosting": GBTClassificationModel,
    "svm": LinearSVCModel,
}


def _scaler_state(scaler):
    return vars(scaler) if scaler else None


def _map_state(landmarks):
    return vars(landmarks) if landmarks else None


def _write(spark, path, state):
    rows = spark.createDataFrame([(json.dumps(state),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}/state")


def save_model(model, folder: str, name: str, spark: SparkSession | None = None) -> str:
    """Saves a classifier, detector or clusterer under a name."""
    spark = spark or SparkSession.getActiveSession()
    path = f"{folder.rstrip('/')}/{name}"
    if isinstance(model, TrainedClassifier):
        state = {
            "kind": "classifier", "model_key": model.model_key, "features": model.features,
            "target": model.target, "key": model.key, "labels": model.labels,
            "positive": model.positive, "scaler": _scaler_state(model.scaler),
            "landmarks": _map_state(model.landmarks), "params": model.params,
            "calibrated": model.calibration is not None,
        }
        if isinstance(model.model, KNNModel):
            state["knn"] = {"k": model.model.k, "weights": model.model.weights}
            model.model.references.write.mode("overwrite").parquet(f"{path}/references")
        elif isinstance(model.model, ExactTree):
            state["tree"] = vars(model.model)
        elif isinstance(model.model, OnlyLabel):
            state["only_label"] = True
        else:
            model.model.write().overwrite().save(f"{path}/model")
        if model.calibration is not None:
            model.calibration.write().overwrite().save(f"{path}/calibration")
    elif isinstance(model, IsolationForest):
        state = {
            "kind": "isolation_forest", "features": model.features, "key": model.key,
            "sample": model.sample, "threshold": model.threshold,
        }
        nodes = spark.createDataFrame(model.nodes, NODE_SCHEMA)
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    elif isinstance(model, OneClassSVM):
        state = {
            "kind": "one_class_svm", "features": model.features, "key": model.key,
            "threshold": model.threshold, "weights": model.weights, "landmarks": vars(model.landmarks),
        }
    elif isinstance(model, LocalOutlierFactor):
        state = {
            "kind": "local_outlier_factor", "features": model.features, "key": model.key,
            "k": model.k, "threshold": model.threshold, "metric": model.metric,
        }
        model.references.write.mode("overwrite").parquet(f"{path}/references")
        model.densities.write.mode("overwrite").parquet(f"{path}/densities")
    elif isinstance(model, KMeansClusterer):
        state = {
            "kind": "kmeans", "features": model.features, "inertia": model.inertia,
            "scaler": _scaler_state(model.scaler),
        }
        model.model.write().overwrite().save(f"{path}/model")
    else:
        raise ModelError(f"cannot save a {type(model).__name__}")
    _write(spark, path, state)
    return path


def load_model(spark: SparkSession, folder: str, name: str):
    """The model saved under a name."""
    path = f"{folder.rstrip('/')}/{name}"
    if name not in list_models(spark, folder):
        raise ModelError(f"model '{name}' is not in {folder}")
    state = json.loads(spark.read.text(f"{path}/state").first()["value"])
    kind = state.pop("kind")
    if kind == "classifier":
        scaler = Scaler(**state["scaler"]) if state["scaler"] else None
        landmarks = LandmarkMap(**state["landmarks"]) if state["landmarks"] else None
        if "knn" in state:
            references = spark.read.parquet(f"{path}/references")
            model = KNNModel(references, state["features"], state["target"], state["key"], **state["knn"])
        elif "tree" in state:
            model = ExactTree(**state["tree"])
        elif "only_label" in state:
            model = OnlyLabel()
        else:
            model = SPARK_MODELS[state["model_key"]].load(f"{path}/model")
        calibration = LogisticRegressionModel.load(f"{path}/calibration") if state["calibrated"] else None
        return TrainedClassifier(
            state["model_key"], model, state["features"], state["target"], state["key"], state["labels"],
            state["positive"], scaler, landmarks, calibration, state["params"],
        )
    if kind == "isolation_forest":
        nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()]
        return IsolationForest(nodes, **state)
    if kind == "one_class_svm":
        return OneClassSVM(LandmarkMap(**state.pop("landmarks")), **state)
    if kind == "local_outlier_factor":
        return LocalOutlierFactor(
            spark.read.parquet(f"{path}/references"), spark.read.parquet(f"{path}/densities"), **state
        )
    scaler = Scaler(**state["scaler"]) if state["scaler"] else None
    return KMeansClusterer(KMeansModel.load(f"{path}/model"), state["features"], scaler, state["inertia"])


def list_models(spark: SparkSession, folder: str) -> list[str]:
    return list_feature_sets(spark, folder)
