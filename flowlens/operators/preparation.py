"""Feature preparation: removal of useless features, scaling, labels, projection."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.columns import numeric_columns
from flowlens.operators.ordering import exact_quantiles
from flowlens.schemas import TARGET
from flowlens.session import materialize


def variances(df: DataFrame, names) -> dict:
    """Sample variance per feature, null for fewer than two rows."""
    if not names:
        return {}
    row = df.agg(*[F.var_samp(F.col(n).cast("double")).alias(n) for n in names]).first()
    return row.asDict()


def constant_features(df: DataFrame, names) -> list[str]:
    """Features whose variance is exactly 0; an undefined variance keeps the feature."""
    found = variances(df, names)
    return [n for n in names if found[n] == 0]


def drop_constant(df: DataFrame, names=None) -> DataFrame:
    return df.drop(*constant_features(df, names or numeric_columns(df)))


MOMENTS = ("n", "x", "y", "xx", "yy", "xy", "raw_xx", "raw_yy")


def _moments(names: list[str]):
    """Numbers, means and centred second moments over the rows where both features of a pair exist.

    A task centres its rows around the means of its first batch.
    """

    def run(frames):
        p, shift = len(names), None
        n, first, squares, products = (np.zeros((p, p)) for _ in range(4))
        for frame in frames:
            if not len(frame):
                continue
            x = frame[names].to_numpy(float)
            known = ~np.isnan(x)
            if shift is None:
                shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
            x, known = np.where(known, x - shift, 0.0), known.astype(float)
            n += known.T @ known
            first += x.T @ known
            squares += (x * x).T @ known
            products += x.T @ x
        if shift is None:
            return
        a, b = (i[n[np.triu_indices(p)] > 0] for i in np.triu_indices(p))
        number, raw_x, raw_y = n[a, b], squares[a, b], squares[b, a]
        x, y = first[a, b] / number, first[b, a] / number
        centred = raw_x - number * x * x, raw_y - number * y * y, products[a, b] - number * x * y
        values = (number, x + shift[a], y + shift[b], *centred, raw_x, raw_y)
        yield pd.DataFrame({"a": a, "b": b, **dict(zip(MOMENTS, values))})

    return run


def _pair_statistics(df: DataFrame, pairs) -> DataFrame:
    """Correlation of each feature pair over the rows where both exist; NaN counts as missing.

    The input is read once: every task passes on one row of moments for each pair, around its own means.
    That small table is kept, and the tasks' moments are merged around the means of all.
    """
    names = sorted({n for pair in pairs for n in pair})
    if not names:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    place = {n: i for i, n in enumerate(names)}
    values = df.select(*[F.nullif(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names])
    schema = "a long, b long, " + ", ".join(f"{c} double" for c in MOMENTS)
    parts = materialize(values.mapInPandas(_moments(names), schema), "pair-moments")

    def mean(name):
        return (F.sum(F.col("n") * F.col(name)) / F.sum("n")).alias(f"mean_{name}")

    means = parts.groupBy("a", "b").agg(F.sum("n").alias("total"), mean("x"), mean("y"))
    gap_x, gap_y = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    sums = parts.join(means, ["a", "b"]).groupBy("a", "b", "total", "mean_x", "mean_y").agg(
        F.sum(F.col("xx") + F.col("n") * gap_x * gap_x).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * gap_y * gap_y).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * gap_x * gap_y).alias("xy"),
        F.sum("raw_xx").alias("raw_xx"),
        F.sum("raw_yy").alias("raw_yy"),
    )

    def spread(square, raw, centre):
        """Variance; rounding noise around a constant is none."""
        found = square / F.col("total")
        return F.when((found > 1e-13 * raw / F.col("total")) & (found > 1e-24 * centre * centre), found)

    vx = spread(F.col("xx"), F.col("raw_xx"), F.col("mean_x"))
    vy = spread(F.col("yy"), F.col("raw_yy"), F.col("mean_y"))
    shared = F.col("xy") / F.col("total")
    wanted = F.array(*[F.struct(F.lit(place[a]).alias("i"), F.lit(place[b]).alias("j")) for a, b in pairs])
    asked = df.sparkSession.range(1).select(F.explode(wanted).alias("p")).select(
        "p.i", "p.j", F.least("p.i", "p.j").cast("long").alias("a"), F.greatest("p.i", "p.j").cast("long").alias("b")
    )
    named = F.array(*[F.lit(n) for n in names])
    known = sums.select(
        "a", "b", F.when((F.col("a") == F.col("b")) & vx.isNotNull(), 1.0).otherwise(shared / F.sqrt(vx) / F.sqrt(vy)).alias("correlation")
    )
    return asked.join(known, ["a", "b"]).select(
        F.element_at(named, F.col("i") + 1).alias("feature_a"), F.element_at(named, F.col("j") + 1).alias("feature_b"), "correlation"
    )


def correlation_pairs(df: DataFrame, names) -> DataFrame:
    """``(feature_a, feature_b, correlation)`` for a before b in the given order."""
    return _pair_statistics(df, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])


def correlation_matrix(df: DataFrame, names=None) -> DataFrame:
    """Pearson matrix in long form: one triangle is aggregated, then mirrored."""
    names = list(names or numeric_columns(df))
    half = _pair_statistics(df, [(a, b) for i, a in enumerate(names) for b in names[i:]])
    forth = F.struct("feature_a", "feature_b", "correlation")
    back = F.struct(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"
    )
    both = F.when(F.col("feature_a") == F.col("feature_b"), F.array(forth)).otherwise(F.array(forth, back))
    return half.select(F.explode(both).alias("r")).select("r.*")


def correlated_features(df: DataFrame, names, threshold: float = 0.95, spread: dict | None = None) -> list[str]:
    """Features to drop so that no kept pair passes the threshold.

    Features are visited in order against every earlier one not dropped yet; of a pair
    above the threshold the lower-variance feature goes, ties dropping the earlier. Known
    variances can be passed as ``spread``.
    """
    if len(names) < 2:
        return []
    spread = spread or variances(df, names)
    strong = {
        (r["feature_a"], r["feature_b"])
        for r in correlation_pairs(df, names).filter(F.abs("correlation") > threshold).collect()
    }
    dropped = set()
    for position, name in enumerate(names):
        for earlier in names[:position]:
            if (earlier, name) in strong and earlier not in dropped:
                dropped.add(name if spread[name] < spread[earlier] else earlier)
    return [n for n in names if n in dropped]


def drop_correlated(df: DataFrame, names=None, threshold: float = 0.95) -> DataFrame:
    return df.drop(*correlated_features(df, list(names or numeric_columns(df)), threshold))


@dataclass
class Scaler:
    """Per-feature shift and scale, applied as column arithmetic."""

    method: str
    columns: list
    shift: dict
    scale: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.columns}
        )

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.columns}
        )


def fit_scaler(df: DataFrame, columns=None, method: str = "standard") -> Scaler:
    """'standard' (population deviation), 'minmax' or 'robust' (median, quartile range).

    A zero scale is replaced by 1, so constant features become 0.
    """
    columns = list(columns or numeric_columns(df))
    if method == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        shift = {c: quartiles[c][1] for c in columns}
        scale = {c: quartiles[c][2] - quartiles[c][0] for c in columns}
    elif method in ("standard", "minmax"):
        centre, spread = (F.avg, F.stddev_pop) if method == "standard" else (F.min, None)
        row = df.agg(
            *[centre(F.col(c).cast("double")).alias(f"a_{i}") for i, c in enumerate(columns)],
            *[
                (
                    spread(F.col(c).cast("double"))
                    if spread
                    else F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))
                ).alias(f"b_{i}")
                for i, c in enumerate(columns)
            ],
        ).first()
        shift = {c: row[f"a_{i}"] for i, c in enumerate(columns)}
        scale = {c: row[f"b_{i}"] for i, c in enumerate(columns)}
    else:
        raise ValueError(f"unknown scaling method: {method}")
    return Scaler(method, columns, shift, {c: scale[c] or 1.0 for c in columns})


def assemble(df: DataFrame, features=None, target: str = TARGET, output: str = "features") -> DataFrame:
    """Numeric columns but the target as one vector; rows with a null feature are dropped."""
    features = list(features or numeric_columns(df, exclude=(target,)))
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="skip").transform(df)


def encode_label(df: DataFrame, target: str = TARGET, output: str = "label"):
    """Labels numbered in sorted order; returns the table and the fitted indexer."""
    indexer = StringIndexer(inputCol=target, outputCol=output, stringOrderType="alphabetAsc").fit(df)
    return indexer.transform(df), indexer


def decode_label(df: DataFrame, labels, column: str = "label", output: str = "decoded") -> DataFrame:
    return IndexToString(inputCol=column, outputCol=output, labels=list(labels)).transform(df)


def pca(df: DataFrame, features, components: int = 2):
    """Standardised projection ``Dim1..`` beside the original columns, and the variance shares."""
    clean = df.na.drop(subset=list(features))
    scaler = fit_scaler(clean, features)
    vectors = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="_v")
    standard = clean.withColumns(
        {
            f"_z{i}": (F.col(c) - F.lit(scaler.shift[c])) / F.lit(scaler.scale[c])
            for i, c in enumerate(features)
        }
    )
    assembled = vectors.transform(standard)
    model = PCA(k=components, inputCol="_v", outputCol="_p").fit(assembled)
    coordinates = vector_to_array("_p")
    projected = model.transform(assembled).select(
        *[coordinates[i].alias(f"Dim{i + 1}") for i in range(components)],
        *[F.col(c) for c in df.columns],
    )
    return projected, [float(x) for x in model.explainedVariance]
