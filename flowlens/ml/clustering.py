"""K-means and DBSCAN behind one interface, and the elbow table."""

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.errors import ModelError
from flowlens.ml.dbscan import dbscan
from flowlens.operators.columns import numeric_columns
from flowlens.operators.preparation import Scaler, fit_scaler
from flowlens.schemas import SEED
from flowlens.session import materialize


@dataclass
class KMeansClusterer:
    """A fitted Spark model with the scaling it was fitted under."""

    model: object
    features: list
    scaler: Scaler | None
    inertia: float

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster``; rows with missing features are left out."""
        return self.model.transform(_vectors(df, self.features, self.scaler)).drop("_vec")

    def centers(self) -> list[list[float]]:
        """Cluster centres in the units of the input."""
        found = [list(map(float, c)) for c in self.model.clusterCenters()]
        if self.scaler is None:
            return found
        shift, scale = self.scaler.shift, self.scaler.scale
        return [[x * scale[f] + shift[f] for f, x in zip(self.features, c)] for c in found]


def _vectors(df: DataFrame, features, scaler: Scaler | None) -> DataFrame:
    names = [f"_f{i}" for i in range(len(features))]
    columns = {
        n: (F.col(f) - scaler.shift[f]) / scaler.scale[f] if scaler else F.col(f).cast("double")
        for n, f in zip(names, features)
    }
    assembler = VectorAssembler(inputCols=names, outputCol="_vec", handleInvalid="skip")
    return assembler.transform(df.withColumns(columns)).drop(*names)


def fit_kmeans(df: DataFrame, features=None, k: int = 2, scale: bool = True, seed: int = SEED) -> KMeansClusterer:
    features = list(features or numeric_columns(df))
    scaler = fit_scaler(df, features) if scale else None
    estimator = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="cluster")
    model = estimator.fit(_vectors(df, features, scaler))
    return KMeansClusterer(model, features, scaler, model.summary.trainingCost)


def cluster(df: DataFrame, features=None, key: str = "ipsrc", method: str = "kmeans", n_clusters: int = 2, **params):
    """Assigns every row to a cluster; returns the table and the fitted clusterer (None for DBSCAN)."""
    features = list(features or numeric_columns(df))
    if method == "kmeans":
        model = fit_kmeans(df, features, n_clusters, **params)
        return model.predict(df), model
    if method == "dbscan":
        return df.join(dbscan(df, features, key, **params), key), None
    raise ModelError(f"unknown clustering method: {method}")


def apply_clusterer(model: KMeansClusterer, df: DataFrame) -> DataFrame:
    if model is None:
        raise ModelError("this clusterer cannot assign new rows")
    return model.predict(df)


def elbow(df: DataFrame, features=None, k_range=(1, 11), scale: bool = False, seed: int = SEED) -> DataFrame:
    """``(k, inertia)`` for each k; one cluster is the total sum of squares."""
    features = list(features or numeric_columns(df))
    df = materialize(df.select(*features), "elbow")
    rows = []
    for k in range(*k_range):
        if k > 1:
            rows.append((k, float(fit_kmeans(df, features, k, scale, seed).inertia)))
            continue
        scaler = fit_scaler(df, features) if scale else None
        clean = df.na.drop(subset=features)
        squares = [
            F.var_pop(F.col(f).cast("double") / (scaler.scale[f] if scaler else 1.0)) * F.count("*")
            for f in features
        ]
        total = clean.agg(*[s.alias(f"s{i}") for i, s in enumerate(squares)]).first()
        rows.append((1, float(sum(total))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")
