"""k-nearest-neighbour classification."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.ml.neighbors import CHUNK_ROWS, knn_join


@dataclass
class KNNModel:
    """Holds the reference table; prediction is a neighbour join and a vote."""

    references: DataFrame
    features: list
    target: str
    key: str
    k: int = 5
    weights: str = "uniform"
    chunk_rows: int = CHUNK_ROWS

    def votes(self, df: DataFrame, exclude_self: bool = False) -> DataFrame:
        """``(key, label, share)`` per class present among the neighbours.

        Under distance weights a neighbour at distance 0 outvotes all others.
        """
        pairs = knn_join(
            df, self.references, self.features, self.k, self.key, exclude_self, self.chunk_rows
        )
        labels = self.references.select(
            F.col(self.key).alias("neighbor"), F.col(self.target).alias("label")
        )
        pairs = pairs.join(labels, "neighbor")
        if self.weights == "distance":
            nearest = F.min("distance").over(W.partitionBy(self.key))
            weight = F.when(nearest == 0, (F.col("distance") == 0).cast("double")).otherwise(
                F.try_divide(F.lit(1.0), F.col("distance"))
            )
        else:
            weight = F.lit(1.0)
        weighted = pairs.withColumn("_w", weight)
        sums = weighted.groupBy(self.key, "label").agg(F.sum("_w").alias("_w"))
        whole = F.sum("_w").over(W.partitionBy(self.key))
        return sums.select(self.key, "label", (F.col("_w") / whole).alias("share"))

    def predict(self, df: DataFrame, positive=None, exclude_self: bool = False) -> DataFrame:
        """Adds ``prediction`` (smallest label on ties) and the share of the positive class."""
        best = F.min(F.struct((-F.col("share")).alias("s"), F.col("label")))
        share = F.sum(F.when(F.col("label") == positive, F.col("share")).otherwise(0.0))
        voted = (
            self.votes(df, exclude_self)
            .groupBy(self.key)
            .agg(best["label"].alias("prediction"), share.alias("probability"))
        )
        return df.join(voted, self.key)


def knn_leave_one_out(
    df: DataFrame, features, target: str, key: str, k: int = 5, weights: str = "uniform",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Leave-one-out accuracy: one neighbour join in which no row sees itself."""
    model = KNNModel(df, features, target, key, k, weights, chunk_rows)
    hit = (F.col("prediction") == F.col(target)).cast("double")
    return model.predict(df, exclude_self=True).agg(
        F.avg(hit).alias("accuracy_mean"),
        F.stddev_pop(hit).alias("accuracy_std"),
        F.count("*").alias("n_samples"),
    )
