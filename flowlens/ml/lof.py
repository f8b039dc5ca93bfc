"""Local outlier factor over the exact neighbour join."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.ml.neighbors import CHUNK_ROWS, knn_join
from flowlens.operators.ordering import exact_quantiles
from flowlens.session import materialize

# Fixed value: keeps the density of points with many copies finite.
EPSILON = 1e-10


@dataclass
class LocalOutlierFactor:
    """Densities of the training rows; scores are negated factors (lower = more anomalous)."""

    references: DataFrame
    densities: DataFrame
    features: list
    key: str
    k: int
    threshold: float | None = None
    chunk_rows: int = CHUNK_ROWS
    training_scores: DataFrame | None = field(default=None, repr=False)
    metric: str = "euclidean"

    def score(self, df: DataFrame, exclude_self: bool = True) -> DataFrame:
        """``(key, raw)``. Rows of the training table skip themselves unless told otherwise."""
        pairs = knn_join(
            df, self.references, self.features, self.k, self.key, exclude_self, self.chunk_rows, self.metric
        )
        pairs = materialize(pairs, "lof-pairs")
        near = pairs.join(
            self.densities.withColumnRenamed(self.key, "neighbor"), "neighbor"
        )
        reach = F.greatest("distance", "k_distance")
        factors = near.groupBy(self.key).agg(
            (1.0 / (F.avg(reach) + EPSILON)).alias("own"), F.avg("density").alias("around")
        )
        return factors.select(self.key, (-(F.col("around") / F.col("own"))).alias("raw"))


def fit_lof(
    df: DataFrame, features, key: str, k: int = 20, contamination: float = 0.1,
    chunk_rows: int = CHUNK_ROWS, metric: str = "euclidean",
) -> LocalOutlierFactor:
    """Neighbour graph by a metric of ``knn_join``, then k-distance, reachability and density by two aggregations."""
    features = features if isinstance(features, str) else list(features)
    rows = df.count()
    k = max(1, min(k, rows - 1))
    pairs = materialize(
        knn_join(df, df, features, k, key, exclude_self=True, chunk_rows=chunk_rows, metric=metric), "lof-graph"
    )
    k_distance = pairs.groupBy(key).agg(F.max("distance").alias("k_distance"))
    reach = pairs.join(k_distance.withColumnRenamed(key, "neighbor"), "neighbor")
    density = reach.groupBy(key).agg(
        (1.0 / (F.avg(F.greatest("distance", "k_distance")) + EPSILON)).alias("density")
    )
    densities = materialize(k_distance.join(density, key), "lof-densities")
    columns = [features] if isinstance(features, str) else features
    model = LocalOutlierFactor(df.select(key, *columns), densities, features, key, k, chunk_rows=chunk_rows, metric=metric)
    near = pairs.join(densities.withColumnRenamed(key, "neighbor"), "neighbor")
    around = near.groupBy(key).agg(F.avg("density").alias("around")).join(densities, key)
    raw = around.select(key, (-(F.col("around") / F.col("density"))).alias("raw"))
    model.training_scores = materialize(raw, "lof-scores")
    model.threshold = exact_quantiles(model.training_scores, ["raw"], [contamination])["raw"][0]
    return model
