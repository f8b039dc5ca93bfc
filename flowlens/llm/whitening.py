"""Whitening of vectors by a covariance that is put together from sums of squares alone.

Entries become integers x = floor(1024 * c) + 100000. With n vectors and sums S, the centred
values d = n * x - S are integers too. Tasks add up d_i ** 2 for every dimension and
(d_i + d_j) ** 2 for every pair of dimensions; by the polarisation identity the difference of
those variances is twice the pair's covariance. All sums are exact: 64-bit limbs inside a block,
whole integers between blocks, decimals in the shuffle. The driver gets one number a pair of
dimensions, whatever the number of vectors, and finds the eigenvectors.

Left out are vectors that are null, hold null or non-finite entries, or are shorter than the
longest of the others (they lack entries); an empty vector has none. Without vectors the result is
empty. Entries beyond 2 ** 52 in size count as that; where centred values outgrow 64 bits, blocks
are summed with Python's integers instead. A deviation that no long can hold is null. Components
whose eigenvalue is zero to double precision have null ``whitened`` values (one vector, or constant
or dependent dimensions), and ``explained`` is null if nothing varies. Equal eigenvalues: any
orthonormal choice, the same for all rows. Repeated rows and ids, and null ids, each keep their
rows; other columns are ignored. The vectors are read once a pass, so a costly input should be
stored first.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 62
BLOCK_ROWS = 1024
LIMB, LOW = 26, (1 << 26) - 1
DIGIT = 40
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def usable(vectors: DataFrame, vector: Column) -> DataFrame:
    """Ids and vectors in which every entry is a finite number."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.col("e").isNotNull() & finite)


def integers(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    values = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(dimension: int):
    def run(batches):
        n, total = 0, np.zeros(dimension, object)
        low, high = np.full(dimension, LARGEST * 2 - 1), np.full(dimension, -LARGEST * 2)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch, dimension)
                n += len(x)
                total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), _decimals(total),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["i", "n", "s", "low", "high"],
            )

    return run


class Fit:
    """Number and sums of the vectors, and whether their centred values leave the limbs."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.i)
        self.dimension, self.n = len(rows), int(rows[0].n)
        self.sums = [int(r.s) for r in rows]
        reach = max(max(abs(r.low), abs(r.high)) for r in rows) * self.n
        spread = max(r.high - r.low for r in rows) * self.n
        self.wide = 2 * reach >= 1 << 62 or spread >= 1 << 51

    def centred(self, x: np.ndarray) -> np.ndarray:
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)


def squares(d: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each column, as whole integers."""
    if d.dtype == object:
        return (d * d).sum(axis=0)
    a, b = d >> LIMB, d & LOW
    high, mixed, low = (np.einsum("ij,ij->j", *x).astype(object) for x in ((a, a), (a, b), (b, b)))
    return high * (1 << 2 * LIMB) + mixed * (1 << LIMB + 1) + low


def _pair_squares(fit: Fit):
    """Sums of squares of every dimension (j = i) and of every sum of two (j > i)."""
    size = fit.dimension

    def run(batches):
        total = [np.zeros(size - i, object) for i in range(size)]
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                d = np.asfortranarray(fit.centred(integers(batch.slice(first, BLOCK_ROWS), size)))
                own = squares(d)
                for i in range(size):
                    total[i][0] += own[i]
                    if i + 1 < size:
                        total[i][1:] += squares(d[:, i + 1 :] + d[:, i : i + 1])
        i, j = np.triu_indices(size)
        q = [int(v) for v in np.concatenate(total)]
        digit = (1 << DIGIT) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([v & digit for v in q], pa.int64()),
             pa.array([v >> DIGIT & digit for v in q], pa.int64()), _decimals(v >> 2 * DIGIT for v in q)],
            ["i", "j", "q0", "q1", "q2"],
        )

    return run


class Whitening:
    """Eigenvectors of the covariance that the sums of squares give."""

    def __init__(self, fit: Fit, rows: list, components: int):
        self.fit, size = fit, fit.dimension
        q = {(r.i, r.j): r.q0 + (r.q1 << DIGIT) + (int(r.q2) << 2 * DIGIT) for r in rows}
        scale = fit.n**3
        cov = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                # 2 d_i d_j = (d_i + d_j)^2 - d_i^2 - d_j^2, and the sums are whole numbers
                cross = q[i, i] if i == j else (q[i, j] - q[i, i] - q[j, j]) // 2
                cov[i, j] = cov[j, i] = cross / scale
        self.covariance = cov
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[top], vectors[:, top]
        self.values = values
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(top))] < 0, -1.0, 1.0)
        trace = sum(q[i, i] for i in range(size)) / scale
        self.explained = values / trace if trace > 0 else np.full(len(top), np.nan)
        self.sound = values > size * np.finfo(float).eps * max(float(values.max()), 0.0) if trace > 0 else np.zeros(len(top), bool)

    def project(self, d: np.ndarray) -> np.ndarray:
        root = np.where(self.sound, np.sqrt(np.abs(self.values)), 1.0)
        return (d.astype(np.float64) / self.fit.n) @ self.vectors / root

    def deviation(self, d: np.ndarray) -> list[int | None]:
        if d.dtype != object:
            rough = (d.astype(np.float64) ** 2).sum(axis=1)
            if not len(rough) or rough.max() < 1 << 62:
                return np.einsum("ij,ij->i", d, d).tolist()
            d = d.astype(object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def _whitened_products(fitted: Whitening):
    """Sums of the whitened columns and of their products."""
    size = len(fitted.values)

    def run(batches):
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = fitted.project(fitted.fit.centred(integers(batch, fitted.fit.dimension)))
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(size), *i], pa.int32()), pa.array([-1] * size + j.tolist(), pa.int32()),
             pa.array(np.append(sums, products[i, j]))],
            ["i", "j", "s"],
        )

    return run


def identity_error(rows: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    summed = rows.mapInArrow(_whitened_products(fitted), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = {(r.i, r.j): r.s / fitted.fit.n for r in summed.collect()}
    sound = np.flatnonzero(fitted.sound).tolist()
    off = [abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in sound for j in sound if j >= i]
    return max(off, default=None)


def _emit(fitted: Whitening, error: float | None):
    size = len(fitted.values)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            d = fitted.fit.centred(integers(batch, fitted.fit.dimension))
            w = fitted.project(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(n), size))),
                 pa.array(np.tile(np.arange(1, size + 1), n), pa.int32()),
                 pa.array([fitted.fit.n] * (n * size), pa.int64()),
                 pa.array(fitted.deviation(d), pa.int64()).take(pa.array(np.repeat(np.arange(n), size))),
                 pa.array(w.ravel(), mask=np.tile(~fitted.sound, n)),
                 pa.array(np.tile(fitted.explained, n), mask=np.tile(np.isnan(fitted.explained), n)),
                 pa.array([error] * (n * size), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Fits over all vectors of ``rows`` (of ``usable``); None if there are none."""
    dimension = rows.agg(F.max(F.size("e"))).first()[0]
    if not dimension:
        return None
    rows = rows.where(F.size("e") == dimension)
    sums = rows.mapInArrow(_sums(dimension), "i int, n long, s decimal(38,0), low long, high long").groupBy("i")
    fit = Fit(sums.agg(*(F.sum(c).alias(c) for c in ("n", "s")), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    pairs = rows.mapInArrow(_pair_squares(fit), "i int, j int, q0 long, q1 long, q2 decimal(38,0)").groupBy("i", "j")
    return Whitening(fit, pairs.agg(*(F.sum(q).alias(q) for q in ("q0", "q1", "q2"))).collect(), components)


def whiten(vectors: DataFrame, components: int = 8, vector: str = "embedding") -> DataFrame:
    """Per vector and component: the whitened value, the share of variance, the vector's exact deviation."""
    rows = usable(vectors, F.col(vector))
    fitted = fit_whitening(rows, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("e") == fitted.fit.dimension)
    return rows.mapInArrow(_emit(fitted, identity_error(rows, fitted)), SCHEMA)
