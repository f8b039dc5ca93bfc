"""RBF kernels by landmarks with a stated error, and the one-class SVM.

Landmarks are chosen by pivoted incomplete Cholesky decomposition (Fine and Scheinberg, 2001).
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.ml.neighbors import points
from flowlens.operators.ordering import exact_quantiles
from flowlens.session import materialize

COMPONENTS = 256
# Landmarks taken in one pass over the rows, and rows that a pass offers.
PIVOTS = 32
CANDIDATES = 256


def scale_gamma(rows: DataFrame, dims: int) -> float:
    """``1 / (dims * variance)`` over all entries of the vectors."""
    moments = rows.select(F.explode("vec").alias("x")).agg(F.var_pop("x").alias("v")).first()
    return 1.0 / (dims * (moments["v"] or 1.0))


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


@dataclass
class LandmarkMap:
    """Map whose inner products are the kernel's projection onto ``landmarks``.

    With their kernel matrix K = L L', a vector x goes to the solution of L y = k(landmarks, x). The
    inner product of two images never exceeds the kernel on the diagonal, and what is missing there,
    ``1 - |y|^2``, is the error of x: ``residual`` is its mean over the fitted rows, ``worst`` its maximum.
    """

    gamma: float
    landmarks: list
    factor: list
    residual: float = 1.0
    worst: float = 1.0

    @property
    def components(self) -> int:
        return len(self.landmarks)

    def transform(self, matrix: np.ndarray) -> np.ndarray:
        near = _kernel(np.array(self.landmarks, dtype=float), matrix, self.gamma)
        return _forward(np.array(self.factor, dtype=float), near).T

    def missing(self, matrix: np.ndarray) -> np.ndarray:
        """What each vector lacks of its kernel with itself."""
        if not self.landmarks:
            return np.ones(len(matrix))
        return np.maximum(1.0 - (self.transform(matrix) ** 2).sum(axis=1), 0.0)

    def column(self, vec):
        plan = self

        @F.pandas_udf("array<double>")
        def mapped(v: pd.Series) -> pd.Series:
            return pd.Series(list(plan.transform(np.array(list(v), dtype=float)))) if len(v) else pd.Series([], dtype=object)

        return mapped(vec)


def _forward(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves ``lower @ out = right``, blocks of rows at a time."""
    out = np.empty_like(right)
    for first in range(0, len(lower), 32):
        last = min(first + 32, len(lower))
        rest = right[first:last] - lower[first:last, :first] @ out[:first]
        out[first:last] = np.linalg.solve(lower[first:last, first:last], rest)
    return out


def _pivoted(found: LandmarkMap, candidates: np.ndarray, number: int, tolerance: float) -> LandmarkMap:
    """Adds up to ``number`` candidates, each time the one that the landmarks so far explain least."""
    vectors = np.array(found.landmarks, dtype=float).reshape(-1, candidates.shape[1])
    lower = np.array(found.factor, dtype=float).reshape(len(vectors), len(vectors))
    images = found.transform(candidates) if len(vectors) else np.zeros((len(candidates), 0))
    left = 1.0 - (images**2).sum(axis=1)
    own = _kernel(candidates, candidates, found.gamma)
    for _ in range(number):
        pick = int(left.argmax())
        if left[pick] <= max(tolerance, 1e-10):
            break
        root = np.sqrt(left[pick])
        column = (own[pick] - images @ images[pick]) / root
        row = np.append(images[pick], root)
        lower = np.block([[lower, np.zeros((len(lower), 1))], [row[None, :]]]) if len(lower) else row[None, :]
        vectors = np.vstack([vectors, candidates[pick]])
        images = np.column_stack([images, column])
        left = left - column**2
        left[pick] = 0.0
    return LandmarkMap(found.gamma, vectors.tolist(), lower.tolist())


def fit_landmarks(rows: DataFrame, gamma: float, components: int = COMPONENTS, tolerance: float = 1e-6) -> LandmarkMap:
    """Landmarks by pivoted incomplete Cholesky over all ``vec`` rows (without nulls).

    Pivots are chosen ``PIVOTS`` a pass: the pass measures what every row still lacks and brings the rows
    that lack most, a bounded number of different ones, to the driver, which picks among those one after
    another. Passes end when no row lacks more than ``tolerance`` or there are ``components`` landmarks; the
    mean of what is lacking (the trace residual) is then the map's stated error. Ties, as before the first
    landmark, go by a hash, so that the offer is spread over all rows.
    """
    vectors = materialize(rows.select("vec").distinct(), "kernel-vectors")
    found = LandmarkMap(gamma, [], [])
    while True:
        worst = _lacking(vectors, found).orderBy(F.desc("lack"), F.xxhash64("vec"), "vec").limit(CANDIDATES).collect()
        enough = not worst or worst[0]["lack"] <= tolerance or found.components >= components
        if not enough:
            before = found.components
            # Residuals change with each pivot, so only some of the candidates are taken in one pass.
            number = min(PIVOTS, components - before)
            found = _pivoted(found, np.array([r["vec"] for r in worst], dtype=float), number, tolerance)
            enough = found.components == before
        if enough:
            lacks = _lacking(rows.select("vec"), found).agg(F.avg("lack").alias("mean"), F.max("lack").alias("most")).first()
            found.residual, found.worst = float(lacks["mean"] or 0.0), float(lacks["most"] or 0.0)
            return found


def _lacking(rows: DataFrame, found: LandmarkMap) -> DataFrame:
    @F.pandas_udf("double")
    def lack(v: pd.Series) -> pd.Series:
        return pd.Series(found.missing(np.array(list(v), dtype=float))) if len(v) else pd.Series([], dtype=float)

    return rows.withColumn("lack", lack("vec"))


@dataclass
class OneClassSVM:
    """Separates the bulk of the rows from the origin of the kernel space."""

    landmarks: LandmarkMap
    weights: list
    features: list
    key: str
    threshold: float = 0.0
    training_scores: DataFrame | None = field(default=None, repr=False)

    def score(self, df: DataFrame) -> DataFrame:
        """``(key, raw)``; rows below ``threshold`` are outside the learned region."""
        return _margins(points(df, self.features, self.key), self.landmarks, self.weights).select(
            F.col("key").alias(self.key), F.col("margin").alias("raw")
        )


def _margins(rows: DataFrame, landmarks: LandmarkMap, weights) -> DataFrame:
    vector = np.array(weights)

    @F.pandas_udf("double")
    def margin(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        return pd.Series(landmarks.transform(np.array(list(v), dtype=float)) @ vector)

    return rows.withColumn("margin", margin("vec"))


def _map_sum(rows: DataFrame, landmarks: LandmarkMap) -> tuple[np.ndarray, int]:
    """Sum of the mapped vectors and their number: one partial sum per partition."""

    def partial(batches):
        total, n = np.zeros(landmarks.components), 0
        for batch in batches:
            if len(batch):
                total += landmarks.transform(np.array(batch["vec"].tolist(), dtype=float)).sum(axis=0)
                n += len(batch)
        yield pd.DataFrame({"i": np.arange(landmarks.components), "s": total, "n": n})

    sums = rows.select("vec").mapInPandas(partial, "i int, s double, n bigint")
    found = sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    vector = np.zeros(landmarks.components)
    for row in found:
        vector[row["i"]] = row["s"]
    return vector, int(found[0]["n"]) if found else 0


def fit_one_class_svm(
    df: DataFrame,
    features,
    key: str,
    nu: float = 0.1,
    gamma: float | None = None,
    iterations: int = 12,
    components: int = COMPONENTS,
) -> OneClassSVM:
    """Sub-gradient descent; each step is two aggregations over all rows.

    For given weights the best offset is the ``nu`` quantile of the margins, so each step
    moves the weights towards the mean of the rows below it; the final offset is exact.
    """
    features = [features] if isinstance(features, str) else list(features)
    rows = materialize(points(df, features, key), "one-class-rows")
    dims = len(rows.select("vec").first()["vec"])
    landmarks = fit_landmarks(rows, gamma or scale_gamma(rows, dims), components)
    total, n = _map_sum(rows, landmarks)
    weights = total / n
    for step in range(1, iterations + 1):
        scored = _margins(rows, landmarks, weights)
        offset = scored.agg(F.percentile_approx("margin", nu, 10000)).first()[0]
        outside, _ = _map_sum(scored.filter(F.col("margin") <= offset), landmarks)
        rate = 1.0 / (step + 1)
        weights = (1 - rate) * weights + rate * outside / (nu * n)
    model = OneClassSVM(landmarks, [float(w) for w in weights], features, key)
    model.training_scores = materialize(model.score(df), "one-class-scores")
    model.threshold = exact_quantiles(model.training_scores, ["raw"], [nu])["raw"][0]
    return model
