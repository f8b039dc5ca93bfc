"""Exact neighbour search as partitioned Spark jobs.

Reference vectors are reduced to distinct ones (copies keep only the keys that can still
be among the nearest), assigned to the closest of a bounded set of pivots, and each pivot
cell is cut into chunks of bounded size. A query visits only cells that the triangle
inequality cannot rule out: a first visit to one chunk bounds its search radius, a second
one visits every cell within it. Each (cell, chunk, query block) is one small task; only
the best few candidates per query and chunk leave it, never the pairs.

In many dimensions the triangle inequality excludes little. There vectors are rotated so that
variance falls from coordinate to coordinate, and distances are summed a few coordinates at a
time: a partial sum is a lower bound of the squared distance, and a reference whose bound is beyond the
query's limit (its radius so far, or the distance to as many references as are wanted) is dropped before
the next coordinates are read. What is left is compared in the original coordinates. Where variance is spread evenly, partial
sums tell little, and whole distances come from one product in single precision, with its rounding error as slack.

If queries visit most cells all the same, the cells are put together for that visit: a few wide chunks, and a row is sent
once for each of them instead of once for each cell. Where queries and references are the same rows, each chunk is first
compared with itself, which bounds the search radius, and then each two chunks once, for the neighbours of both.

Distances are Euclidean, sums (``manhattan``) or maxima (``chebyshev``) of coordinate differences, or ``cosine``. Sums and
maxima keep the coordinates as they are, since no rotation preserves them; partial ones are lower bounds too. Vectors
compared by cosine are brought to length one, where half the squared distance is one minus the cosine; those
without a direction (zero vectors) are left out. For sums and maxima, coordinates are cut into whole steps that fit a byte;
steps between two vectors, less what the steps lack of both, bound their distance from below and rule out most pairs.

Method: Voronoi partitioning for k-nearest-neighbour joins (Lu, Shen, Chen, Ooi, 2012).
"""

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowlens.errors import ModelError
from flowlens.operators.ordering import hash_key
from flowlens.session import materialize

MAX_PIVOTS = 512
CHUNK_ROWS = 4096
QUERY_ROWS = 4096
BLOCK = 256
# References that a block of queries is compared with at a time, and those of two chunks compared both ways.
SLICE, TILE = 4096, 1024
# Share of visited cells from which they are put together, numbers in a wide chunk, its most rows, and the least number of them.
MOST = 0.5
WIDE_NUMBERS, WIDE_ROWS, WIDE_CHUNKS = 1 << 22, 1 << 16, 8
# Share of the variance that the first quarter of the axes holds where partial sums are worth it.
UNEVEN = 0.5
# Rotated coordinates that each partial sum adds.
STEP = 8
# The limit is looked at again after so many steps.
RENEW_STEPS = 3
# Share of open pairs below which they are listed instead of summed as a whole block.
SPARSE_SHARE = 0.35
PAIR_ROWS = 1 << 16
# Steps that a coordinate is cut into for a bound in bytes, coordinates whose gaps a byte sums, rows of a block taken at once,
# share of the coordinates left beyond either end of the steps, and share of open pairs above which bytes are given up.
LEVELS = {"manhattan": 63, "chebyshev": 127}
BYTE_SUMS, BYTE_ROWS, BEYOND, MANY_OPEN = 4, 64, 0.005, 0.15
METRICS = ("euclidean", "manhattan", "chebyshev", "cosine")


def points(df: DataFrame, features, key: str) -> DataFrame:
    """``(key, vec)`` for rows without missing features; ``features`` may name one array column."""
    features = [features] if isinstance(features, str) else list(features)
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        vec = F.col(features[0]).cast("array<double>")
        return df.select(F.col(key).alias("key"), vec.alias("vec")).filter(
            F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
        )
    # Adding 0.0 makes -0.0 and 0.0 the same vector.
    vec = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])
    return df.na.drop(subset=features).select(F.col(key).alias("key"), vec.alias("vec"))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """``(rep, vec, weight, keys)``: copies merged, their ``keep`` smallest keys kept.

    Copies are counted with partial aggregation, and the kept keys are cut to ``keep`` per
    vector before the shuffle, so a vector repeated in a third of all rows stays small.
    """
    first = W.partitionBy("vec").orderBy("key")
    kept = (
        rows.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= keep)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
    )
    weights = rows.groupBy("vec").agg(F.count("*").alias("weight"))
    return kept.join(weights, "vec").select(F.col("keys")[0].alias("rep"), "vec", "weight", "keys")


@dataclass
class Index:
    """Reference vectors in pivot cells; the arrays have one entry per pivot."""

    refs: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    far: np.ndarray
    chunks: np.ndarray
    keep: int
    axes: np.ndarray | None = None
    metric: str = "euclidean"


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=float)


def _length(difference: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Length of each difference (last axis)."""
    if metric == "manhattan":
        return np.abs(difference).sum(axis=-1)
    if metric == "chebyshev":
        return np.abs(difference).max(axis=-1)
    return np.sqrt((difference**2).sum(axis=-1))


def _distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances by coordinate differences, one row of ``a`` at a time."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = _length(b - row, metric)
    return out


def _nearest_pivot(pivots: np.ndarray, metric: str):
    @F.pandas_udf("cell int, dist double")
    def assign(vec: pd.Series) -> pd.DataFrame:
        gaps = _distances(_matrix(vec), pivots, metric)
        cell = gaps.argmin(axis=1) if len(gaps) else np.zeros(0, int)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": gaps[np.arange(len(gaps)), cell]})

    return assign


def build_index(
    reference: DataFrame, chunk_rows: int = CHUNK_ROWS, seed: int = 42, keep: int = 0, metric: str = "euclidean"
) -> Index:
    """Index over ``(rep, vec, ...)`` rows of distinct vectors."""
    total = reference.count()
    wanted = int(min(MAX_PIVOTS, max(1, 2 * total // chunk_rows)))
    if wanted == 1:
        # Few vectors: one cell that every query visits, nothing to place.
        chunks = np.array([max(1, -(-total // chunk_rows))])
        refs = reference.withColumn("cell", F.lit(0))
        refs = refs.withColumn("chunk", F.pmod(F.xxhash64("rep"), _per_cell(chunks)))
        zero, none = np.zeros(1), np.zeros((1, 1))
        return Index(refs, none, np.array([total]), zero, np.array([np.inf]), chunks, keep, metric=metric)
    chosen = reference.orderBy(hash_key("rep", seed), "rep").limit(wanted).select("vec").collect()
    pivots = _matrix([r["vec"] for r in chosen])
    placed = reference.withColumn("_p", _nearest_pivot(pivots, metric)("vec")).select(
        *reference.columns, F.col("_p.cell").alias("cell"), F.col("_p.dist").alias("dist")
    )
    placed = materialize(placed, "neighbor-index")
    sizes, near, far = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots))
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")
    )
    for row in stats.collect():
        sizes[row["cell"]], near[row["cell"]], far[row["cell"]] = row["n"], row["near"], row["far"]
    chunks = np.ceil(sizes / chunk_rows).astype(int)
    refs = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), _per_cell(np.maximum(chunks, 1))))
    return Index(refs, pivots, sizes, near, far, chunks, keep, metric=metric)


def _per_cell(values):
    """Value of the row's cell; the list has one entry per pivot, so it is bounded."""
    literal = F.array(*[F.lit(int(v)) for v in values])
    return F.element_at(literal, F.col("cell") + 1)


def _cells_within(index: Index):
    """Cells that may hold a reference within the radius of each query."""
    pivots, sizes, near, far, metric = index.pivots, index.sizes, index.near, index.far, index.metric
    between = _distances(pivots, pivots, metric)

    @F.pandas_udf("array<int>")
    def visit(vec: pd.Series, radius: pd.Series) -> pd.Series:
        gaps = _distances(_matrix(vec), pivots, metric) if len(vec) else np.zeros((0, len(pivots)))
        out = []
        for gap, reach in zip(gaps, radius):
            home = int(gap.argmin())
            bound = np.maximum(gap - far, near - gap)
            split = 2 * between[home]
            apart = split > 0
            if metric in ("manhattan", "chebyshev"):  # no right angles: only half the difference is sure
                bound = np.maximum(bound, (gap - gap[home]) / 2)
            else:
                bound[apart] = np.maximum(bound[apart], (gap[apart] ** 2 - gap[home] ** 2) / split[apart])
            # Rounding slack keeps a cell whose bound equals the radius.
            slack = 1e-9 * (1.0 + gap)
            out.append(np.flatnonzero((sizes > 0) & (bound <= reach + slack)).astype("int32"))
        return pd.Series(out)

    return visit


def _home_cell(index: Index):
    pivots, sizes, metric = index.pivots, index.sizes, index.metric

    @F.pandas_udf("array<int>")
    def home(vec: pd.Series) -> pd.Series:
        gaps = _distances(_matrix(vec), pivots, metric) if len(vec) else np.zeros((0, len(pivots)))
        gaps[:, sizes == 0] = np.inf
        return pd.Series([np.array([g.argmin()], dtype="int32") for g in gaps])

    return home


def _visit(index: Index, queries: DataFrame, kernel, schema: str, one_chunk: bool, same: bool = False) -> DataFrame:
    """Runs ``kernel(queries, references)`` on every visited (cell, chunk, query block).

    ``queries`` carries ``cells``. A cell visited by many queries gets several query
    blocks, each with its own copy of the chunk's references. With ``same``, queries are the references, with their keys.
    """
    loads = np.zeros(len(index.pivots))
    if len(loads) == 1:
        loads[0] = queries.count()
    else:
        queries = materialize(queries, "neighbor-visits")
        visits = queries.select(F.explode("cells").alias("cell")).groupBy("cell").count()
        for row in visits.collect():
            loads[row["cell"]] = row["count"]
    blocks = np.ceil(loads / QUERY_ROWS).astype(int)
    if not one_chunk and len(loads) > 1 and loads.sum():
        total = queries.count()
        if loads.sum() >= MOST * total * (index.sizes > 0).sum():
            if same:
                return _both_ways(queries, _wide(total, index.pivots.shape[1]), kernel, schema, index.keep, index.metric)
            # Few queries need few copies of the references.
            few = min(WIDE_CHUNKS, -(-WIDE_CHUNKS * total // int(index.sizes.sum())))
            index, blocks = _one_cell(index), np.array([_wide(total, index.pivots.shape[1], few)])
            queries = queries.withColumn("cells", F.array(F.lit(0)))
    chunk_count = np.maximum(index.chunks, 1)
    left = queries.withColumn("cell", F.explode("cells")).drop("cells")
    if one_chunk:
        left = left.withColumn("chunk", F.pmod(F.xxhash64("rep"), _per_cell(chunk_count)))
    else:
        left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), _per_cell(chunk_count) - 1)))
    left = left.withColumns(
        {
            "chunk": F.col("chunk").cast("int"),
            "block": F.pmod(F.xxhash64("rep", F.lit(7)), _per_cell(np.maximum(blocks, 1))).cast("int"),
        }
    )
    right = (
        index.refs.filter(_per_cell(blocks) > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0), _per_cell(np.maximum(blocks, 1)) - 1)))
        .withColumn("chunk", F.col("chunk").cast("int"))
    )
    where = ["cell", "chunk", "block"]
    return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(kernel, schema)


def _wide(rows: int, dims: int, least: int = WIDE_CHUNKS) -> int:
    """Number of wide chunks or query blocks for so many rows."""
    return max(least, -(-rows // max(CHUNK_ROWS, min(WIDE_ROWS, WIDE_NUMBERS // dims))))


def _one_cell(index: Index) -> Index:
    """The same references in wide chunks of a single cell."""
    total = int(index.sizes.sum())
    chunks = np.array([_wide(total, index.pivots.shape[1])])
    refs = index.refs.withColumn("cell", F.lit(0))
    refs = refs.withColumn("chunk", F.pmod(F.xxhash64("rep"), _per_cell(chunks)))
    return replace(index, refs=refs, pivots=index.pivots[:1], sizes=np.array([total]), chunks=chunks)


def _both_ways(rows: DataFrame, chunks: int, kernel, schema: str, keep: int, metric: str) -> DataFrame:
    """Best candidates of ``(rep, vec, keys, radius)`` rows among themselves: ``kernel`` inside every wide chunk, then each two
    chunks in one task. A row is sent once for each chunk, and a task of two chunks holds no more than one of ``_visit``."""
    chunk = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(chunks)).cast("int")
    rows = rows.select("rep", "vec", "keys", "radius", chunk.alias("chunk"))
    inside = rows.repartitionById(chunks, "chunk").groupBy("chunk").applyInPandas(lambda frame: kernel(frame, frame), schema)
    inside = materialize(inside, "neighbor-inside")
    rows = materialize(_with_radius(rows, inside, keep), "neighbor-rows")
    last = F.lit(chunks - 1)
    # Each two chunks are numbered, so that every one of these equally large tasks is a partition of its own.
    task = (F.shiftright(F.col("low") * (2 * last - F.col("low") + 1), 1) + F.col("high") - F.col("low") - 1).cast("int")
    left = rows.withColumns({"low": F.col("chunk"), "high": F.explode(F.when(F.col("chunk") < last, F.sequence(F.col("chunk") + 1, last)))})
    right = rows.withColumns({"low": F.explode(F.when(F.col("chunk") > 0, F.sequence(F.lit(0), F.col("chunk") - 1))), "high": F.col("chunk")})
    left, right = (
        side.select(*(F.col(c).alias(c) for c in ("rep", "vec", "keys", "radius")), task.alias("task")).repartitionById(chunks * (chunks - 1) // 2, "task").groupBy("task")
        for side in (left, right)
    )
    compare = _both_kernel(keep, metric) if metric in LEVELS else _both_kernel(keep)
    return inside.unionByName(left.cogroup(right).applyInPandas(compare, schema))


def _with_radius(queries: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """Queries with the distance of their last wanted candidate as ``radius``; where there are too few, it stays as it was."""
    radius = (
        found.filter(F.col("rep").isNotNull())
        .groupBy("rep")
        .agg(F.max("distance").alias("d"), F.count("*").alias("n"))
        .select("rep", F.when(F.col("n") >= keep, F.col("d")).alias("_found"))
    )
    return queries.join(radius, "rep", "left").withColumn("radius", F.least("radius", "_found")).drop("_found")


def variance_axes(vectors: DataFrame) -> np.ndarray | None:
    """Orthonormal axes of ``vec`` by falling variance, None if there are too few dimensions to save any.

    Any orthonormal axes give right results, so plain sums are good enough. The driver gets one number
    for each pair of dimensions.
    """
    found = _principal(vectors)
    return None if found is None else found[1]


def _uneven_axes(vectors: DataFrame) -> np.ndarray | None:
    """:func:`variance_axes` if the first ones hold so much of the variance that partial sums tell pairs apart early."""
    found = _principal(vectors)
    if found is None:
        return None
    shares, axes = found
    return axes if shares[: len(shares) // 4].sum() >= UNEVEN * shares.sum() else None


def _principal(vectors: DataFrame):
    """Variances along orthonormal axes, falling, and the axes."""

    def sums(frames):
        n, total, products = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                x = _matrix(frame["vec"])
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        dims = len(total) if n else 0
        if dims >= 2 * STEP:
            i, j = np.triu_indices(dims)
            rows = [*range(dims), *i.tolist(), -1], [-1] * dims + j.tolist() + [-1], [*total, *products[i, j], n]
            yield pd.DataFrame(dict(zip("ijs", rows)))

    summed = vectors.select("vec").mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = {(r["i"], r["j"]): r["s"] for r in summed.collect()}
    if not found:
        return None
    dims = 1 + max(i for i, _ in found)
    mean = np.array([found[i, -1] for i in range(dims)]) / found[-1, -1]
    cov = np.array([[found[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]) / found[-1, -1]
    cov -= np.outer(mean, mean)
    if not np.isfinite(cov).all():
        return None
    values, axes = np.linalg.eigh(cov)
    return np.maximum(values[::-1], 0.0), axes[:, ::-1]


def _near_candidates(queries, refs, axes, radius, keep: int):
    """Per block of queries: its first query, pairs (query, reference) that may be among the ``keep`` nearest
    and within the radius, and how many pairs had their distance summed to the end."""
    if axes is None:
        axes = np.eye(queries.shape[1])
    dims = queries.shape[1]
    borders = [*range(0, dims, STEP), dims] if dims >= 2 * STEP else [0, dims]
    turned, all_refs = queries @ axes, refs @ axes
    last = min(keep, len(refs)) - 1
    norms = (queries**2).sum(axis=1).max(initial=0.0) + (refs**2).sum(axis=1).max(initial=0.0)
    error = 1e-13 * refs.shape[1] * norms + 1e-300
    for start in range(0, len(queries), BLOCK):
        block = turned[start : start + BLOCK]
        limit = radius[start : start + BLOCK] ** 2
        partial, low, at = np.zeros((len(block), len(refs))), 0, None
        for step, high in enumerate(borders[1:]):
            a, b = block[:, low:high], all_refs[:, low:high]
            if at is None:
                partial += (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * a @ b.T
                if step % RENEW_STEPS == 0 and len(refs) >= keep:
                    # Full distances of those that look nearest bound the wanted ones.
                    look = np.argpartition(partial, last, axis=1)[:, : last + 1]
                    full = ((all_refs[look] - block[:, None]) ** 2).sum(axis=2).max(axis=1)
                    limit = np.minimum(limit, full)
                open_, summed = partial <= limit[:, None] + 2 * error, partial.size
                if high == refs.shape[1] or open_.mean() < SPARSE_SHARE:
                    at = np.nonzero(open_)
                    sums = partial[at]
            else:
                for first in range(0, len(sums), PAIR_ROWS):
                    i, j = (x[first : first + PAIR_ROWS] for x in at)
                    sums[first : first + PAIR_ROWS] += ((a[i] - b[j]) ** 2).sum(axis=1)
                open_, summed = sums <= limit[at[0]] + 2 * error, len(sums)
                at, sums = tuple(x[open_] for x in at), sums[open_]
            low = high
        yield start, at[0], at[1], summed


def _lower_bounds(queries, refs):
    """Factors of a product in single precision that, with ``1 - share`` of a query's squared length, bounds squared distances from below.

    Vectors are taken from the references' mean; the squared lengths of both are returned. A pair's rounding error is below
    ``share`` of their sum, and below ``rest`` in what double precision loses. Vectors beyond single precision are left to double.
    """
    dims, middle = queries.shape[1], refs.mean(axis=0)
    a, b = queries - middle, refs - middle
    rest = 1e-13 * dims * ((queries**2).sum(axis=1).max(initial=0.0) + (refs**2).sum(axis=1).max(initial=0.0)) + 1e-300
    lengths, sizes = (a**2).sum(axis=1), (b**2).sum(axis=1)
    kind = np.float32 if 1e-20 < max(lengths.max(initial=0.0), sizes.max(initial=0.0)) < 1e30 else np.float64
    share = (dims + 16) * float(np.finfo(kind).eps)
    # Squares of very small numbers vanish in single precision.
    rest += 1e-35 if kind is np.float32 else 0.0
    left = np.column_stack([-2.0 * a, np.ones(len(a))]).astype(kind)
    right = np.column_stack([b, (1 - share) * sizes]).astype(kind)
    return left, right, lengths, sizes, share, rest


def _set_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few set entries, eight of a row at a time."""
    if mask.shape[1] % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    at, place = np.nonzero(mask.reshape(-1, 8)[some])
    return np.divmod(some[at] * 8 + place, mask.shape[1])


def _renewed(limit, own, values, keep: int) -> np.ndarray:
    """Limits cut to the ``keep``-th smallest of each query's values, where it has so many."""
    order = np.lexsort((values, own))
    edges = np.searchsorted(own[order], np.arange(len(limit) + 1))
    enough = np.flatnonzero(np.diff(edges) >= keep)
    limit = limit.copy()
    limit[enough] = np.minimum(limit[enough], values[order][edges[enough] + keep - 1])
    return limit


def _near_by_product(queries, refs, radius, keep: int):
    """:func:`_near_candidates` by whole distances in single precision, a slice of references at a time."""
    last = min(keep, len(refs), SLICE) - 1
    left, right, lengths, sizes, share, rest = _lower_bounds(queries, refs)
    # What a bound from below lacks of one from above.
    spread = 2 * share * (lengths + sizes.max(initial=0.0)) + 4 * rest
    for start in range(0, len(queries), BLOCK):
        block = slice(start, start + BLOCK)
        base = (1 - share) * lengths[block]
        limit = radius[block] ** 2
        own, near, lows, size = [], [], [], 2 * keep * len(base)
        for first in range(0, len(refs), SLICE):
            bound = left[block] @ right[first : first + SLICE].T
            if not first and last + 1 >= keep and not np.isfinite(limit).all():
                look = np.argpartition(bound, last, axis=1)[:, : last + 1]
                limit = np.minimum(limit, ((refs[look] - queries[block][:, None]) ** 2).sum(axis=2).max(axis=1))
            slack = share * (limit + lengths[block])
            most = limit + 2 * rest - base + np.where(np.isfinite(slack), slack, 0.0)
            with np.errstate(over="ignore"):
                i, j = _set_places(bound <= most.astype(bound.dtype)[:, None])
            own.append(i)
            near.append(j + first)
            lows.append(bound[i, j].astype(float))
            # Renewed when the open pairs have doubled: that costs little for each of them.
            if first + SLICE >= len(refs) or sum(map(len, own)) >= size:
                found, places, least = np.concatenate(own), np.concatenate(near), np.concatenate(lows)
                limit = _renewed(limit, found, least + (base + spread[block])[found], keep)
                open_ = least <= (limit + 2 * rest - base + spread[block])[found]
                own, near, lows = [found[open_]], [places[open_]], [least[open_]]
                size = max(size, 2 * len(own[0]))
        own, near = own[0], near[0]
        order = np.argsort(own, kind="stable")
        yield start, own[order], near[order], len(queries[block]) * len(refs)


def _near_both(left, right, left_radius, right_radius):
    """Pairs of two sets of vectors that may lie within the radius of either, by one product in single precision."""
    a, b, lengths, sizes, share, rest = _lower_bounds(left, right)
    # Both squared lengths are columns here: all terms sum to less than twice their sum, which the share still covers.
    a = np.column_stack([a, ((1 - share) * lengths).astype(a.dtype)])
    b = np.column_stack([b, np.ones(len(b), b.dtype)])
    most = [(1 + share) * radius**2 + 2 * rest for radius in (left_radius, right_radius)]
    # Rows of similar limits together: one limit for all pairs of a tile leaves few of them.
    orders = [np.argsort(m, kind="stable") for m in most]
    (own_most, near_most), (a, b) = (m[o] for m, o in zip(most, orders)), (x[o] for x, o in zip((a, b), orders))
    own, near = [], []
    for start in range(0, len(a), BLOCK):
        for first in range(0, len(b), TILE):
            bound = a[start : start + BLOCK] @ b[first : first + TILE].T
            limit = max(own_most[start : start + BLOCK][-1], near_most[first : first + TILE][-1])
            with np.errstate(over="ignore"):
                limit = np.nextafter(bound.dtype.type(limit), bound.dtype.type(np.inf))
            i, j = _set_places(bound <= limit)
            open_ = bound[i, j] <= np.maximum(own_most[start + i], near_most[first + j])
            own.append(start + i[open_])
            near.append(first + j[open_])
    return orders[0][np.concatenate(own)], orders[1][np.concatenate(near)]


def _near_by_parts(queries, refs, metric: str, radius, keep: int):
    """:func:`_near_candidates` for sums and maxima of coordinate differences, in single precision until few pairs are open."""
    add, whole = (np.add, np.sum) if metric == "manhattan" else (np.maximum, np.max)
    dims, last = queries.shape[1], min(keep, len(refs), SLICE) - 1
    middle = refs.mean(axis=0)
    a, b = queries - middle, refs - middle
    most = np.abs(a).sum(axis=1).max(initial=0.0) + np.abs(b).sum(axis=1).max(initial=0.0)
    kind = np.float32 if 1e-20 < most < 1e30 else np.float64
    error = 1e-13 * dims * (np.abs(queries).sum(axis=1).max(initial=0.0) + np.abs(refs).sum(axis=1).max(initial=0.0)) + 1e-300
    error += (dims + 16) * float(np.finfo(kind).eps) * most
    left, right = a.astype(kind), np.ascontiguousarray(b.astype(kind).T)
    borders = [*range(STEP, dims, STEP), dims]
    for start in range(0, len(queries), BLOCK):
        block, rows = slice(start, start + BLOCK), len(queries[start : start + BLOCK])
        limit, own, near, total = radius[block].copy(), [], [], 0
        for first in range(0, len(refs), SLICE):
            part = right[:, first : first + SLICE]
            partial, low, at = np.zeros((rows, part.shape[1]), kind), 0, None
            gap = np.empty_like(partial)
            for step, high in enumerate(borders):
                if at is None:
                    for c in range(low, high):
                        np.subtract(left[block, c, None], part[c], out=gap)
                        np.abs(gap, out=gap)
                        add(partial, gap, out=partial)
                    if not first and step % RENEW_STEPS == 0 and last + 1 >= keep:
                        look = np.argpartition(partial, last, axis=1)[:, : last + 1]
                        limit = np.minimum(limit, _length(refs[look] - queries[block][:, None], metric).max(axis=1))
                    open_, summed = partial <= (limit + 2 * error)[:, None], partial.size
                    if high == dims or open_.mean() < SPARSE_SHARE / 4:
                        at = _set_places(open_)
                        sums = partial[at].astype(float)
                else:
                    for some in range(0, len(sums), PAIR_ROWS):
                        piece = slice(some, some + PAIR_ROWS)
                        more = whole(np.abs(a[start + at[0][piece], low:high] - b[first + at[1][piece], low:high]), axis=1)
                        sums[piece] = add(sums[piece], more)
                    open_, summed = sums <= limit[at[0]] + 2 * error, len(sums)
                    at, sums = tuple(x[open_] for x in at), sums[open_]
                low = high
            # What is open is summed to the end: its wanted distances bound those of the next slices.
            order = np.lexsort((sums, at[0]))
            edges = np.searchsorted(at[0][order], np.arange(rows + 1))
            enough = np.flatnonzero(np.diff(edges) >= keep)
            limit[enough] = np.minimum(limit[enough], sums[order][edges[enough] + keep - 1] + error)
            open_ = sums <= limit[at[0]] + 2 * error
            own.append(at[0][open_])
            near.append(at[1][open_] + first)
            total += summed
        own, near = np.concatenate(own), np.concatenate(near)
        order = np.argsort(own, kind="stable")
        yield start, own[order], near[order], total


def _aligned(rows: int, columns: int, kind) -> np.ndarray:
    """An array whose rows begin at multiples of 64 bytes."""
    wide = -(-columns * np.dtype(kind).itemsize // 64) * 64
    found = np.empty(rows * wide + 64, np.uint8)
    start = -found.ctypes.data % 64
    return found[start : start + rows * wide].view(kind).reshape(rows, -1)[:, :columns]


class _Levels:
    """Two sets of vectors with coordinates cut into whole steps, for lower bounds of sums and maxima of coordinate differences in bytes.

    A coordinate beyond the first or last step counts as that, which brings no two further apart. What the steps lack of a
    vector's coordinates (``left_rest``, ``right_rest``) is summed, or its maximum taken, like a distance: steps between two
    vectors are more than their distance by no more than both rests.
    """

    def __init__(self, left, right, metric: str):
        self.metric, most = metric, LEVELS[metric]
        ends = [np.quantile(right, share, axis=0) for share in (BEYOND, 1 - BEYOND)]
        self.step = float((ends[1] - ends[0]).max()) / most
        sums = [np.abs(x).sum(axis=1).max(initial=0.0) for x in (left, right)]
        self.error = 1e-13 * left.shape[1] * sum(sums) + 1e-300
        # Also false for what is no number.
        self.useful = 1e-200 < self.step < 1e200 and self.step > self.error
        if self.useful:
            low = (ends[0] + ends[1] - most * self.step) / 2
            (self.left, self.left_rest), (self.right, self.right_rest) = (self._cut(x, low, most) for x in (left, right))
            self.columns = [self.left[c][:, None] for c in range(len(self.left))]
            # References that lack less than others start with the difference, in steps.
            self.most_rest = self.right_rest.max(initial=0.0)
            kind = np.uint8 if metric == "chebyshev" else np.uint16 if most * (left.shape[1] + 2) < 1 << 16 else np.uint32
            self.start = np.floor((self.most_rest - self.right_rest) / self.step).astype(kind)
            self.gap, self.sums, self.total = (_aligned(BYTE_ROWS, min(SLICE, len(right)), t) for t in (np.int8, np.uint8, kind))

    def _cut(self, x, low, most: int):
        whole = _aligned(x.shape[1], len(x), np.int8)
        rest = np.empty(len(x))
        for first in range(0, len(x), SLICE):
            place = np.clip((x[first : first + SLICE] - low) / self.step, 0, most)
            steps = np.rint(place)
            whole[:, first : first + SLICE] = steps.T
            rest[first : first + SLICE] = _length(place - steps, self.metric) * self.step
        return whole, rest

    def between(self, rows: slice, some: slice):
        """Steps between rows of the left, ``BYTE_ROWS`` at most, and some of the right; the result is used up by the next call."""
        part = self.right[:, some]
        size = self.left[0, rows].size, part.shape[1]
        gap, sums, total = (x[: size[0], : size[1]] for x in (self.gap, self.sums, self.total))
        if self.metric == "chebyshev":
            for c, column in enumerate(self.columns):
                np.subtract(column[rows], part[c], out=gap)
                np.abs(gap, out=gap)
                np.maximum(total, gap.view(np.uint8), out=total) if c else np.copyto(total, gap.view(np.uint8))
            return total
        base = self.start[some]
        for low in range(0, len(part), BYTE_SUMS):
            for c in range(low, min(low + BYTE_SUMS, len(part))):
                out = gap if c > low else sums.view(np.int8)
                np.subtract(self.columns[c][rows], part[c], out=out)
                np.abs(out, out=out)
                if c > low:
                    np.add(sums, gap.view(np.uint8), out=sums)
            base = np.add(base, sums, out=total)
        return total

    def open_pairs(self, rows: slice, some: slice, limit):
        """Mask of the pairs of these rows of the left and some of the right that may lie within the limit."""
        steps = np.floor((limit + self.left_rest[rows] + self.most_rest + self.error) / self.step * (1 + 1e-12))
        most = LEVELS[self.metric] if self.metric == "chebyshev" else np.iinfo(self.total.dtype).max
        most = np.where(steps < most, steps, most).astype(self.total.dtype)
        if self.metric == "manhattan":
            return self.between(rows, some) <= most[:, None]
        # A difference from -most to most, and most added, stays in its order as a byte without sign; any other wraps around beyond.
        part = self.right[:, some].view(np.uint8)
        least = self.left[:, rows].view(np.uint8) - most
        gap, total = (x.view(np.uint8)[: len(most), : part.shape[1]] for x in (self.gap, self.total))
        for c in range(len(part)):
            np.subtract(part[c], least[c][:, None], out=gap if c else total)
            if c:
                np.maximum(total, gap, out=total)
        return total <= 2 * most[:, None]


def _near_by_levels(queries, refs, metric: str, radius, keep: int):
    """:func:`_near_candidates` for sums and maxima of coordinate differences: most pairs are ruled out by steps in bytes.

    Blocks of queries for which that leaves too many go to :func:`_near_by_parts`.
    """
    levels, last = _Levels(queries, refs, metric), min(keep, len(refs), SLICE) - 1
    if not levels.useful:
        yield from _near_by_parts(queries, refs, metric, radius, keep)
        return
    for start in range(0, len(queries), BLOCK):
        block = queries[start : start + BLOCK]
        limit = radius[start : start + BLOCK].copy()
        own, near, gaps, size, seen, summed = [], [], [], 2 * keep * len(block), 0, 0
        for first in range(0, len(refs), SLICE):
            some, open_ = slice(first, min(first + SLICE, len(refs))), 0
            for row in range(0, len(block), BYTE_ROWS):
                rows = slice(start + row, start + min(row + BYTE_ROWS, len(block)))
                inside = slice(row, row + BYTE_ROWS)
                if not first and last + 1 >= keep and not np.isfinite(limit[inside]).all():
                    # Full distances of those that look nearest bound the wanted ones.
                    look = np.argpartition(levels.between(rows, some), last, axis=1)[:, : last + 1]
                    limit[inside] = np.minimum(limit[inside], _length(refs[look] - block[inside, None], metric).max(axis=1))
                i, j = _set_places(levels.open_pairs(rows, some, limit[inside]))
                open_ += len(i)
                if open_ > MANY_OPEN * len(block) * (some.stop - first):
                    break
                i, j = i + row, j + first
                gap = _exact(block, refs, i, j, metric)
                kept = gap <= limit[i]
                own.append(i[kept])
                near.append(j[kept])
                gaps.append(gap[kept])
            if open_ > MANY_OPEN * len(block) * (some.stop - first):
                break
            summed += open_
            # Renewed when the references seen or the open pairs have doubled: that costs little for each of them.
            if some.stop >= min(2 * seen, len(refs)) or sum(map(len, own)) >= size:
                seen = some.stop
                own, near, gaps = np.concatenate(own), np.concatenate(near), np.concatenate(gaps)
                limit = _renewed(limit, own, gaps, keep)
                kept = gaps <= limit[own]
                own, near, gaps = [own[kept]], [near[kept]], [gaps[kept]]
                size = max(size, 2 * len(own[0]))
        else:
            order = np.argsort(own[0], kind="stable")
            yield start, own[0][order], near[0][order], summed
            continue
        for _, own, near, summed in _near_by_parts(block, refs, metric, limit, keep):
            yield start, own, near, summed


def _near_both_by_levels(left, right, left_radius, right_radius, metric: str):
    """:func:`_near_both` for sums and maxima of coordinate differences, by steps in bytes."""
    # Rows of similar limits together: one limit for all pairs of a tile leaves few of them.
    orders = [np.argsort(radius, kind="stable") for radius in (left_radius, right_radius)]
    (own_most, near_most), (a, b) = (r[o] for r, o in zip((left_radius, right_radius), orders)), (x[o] for x, o in zip((left, right), orders))
    levels = _Levels(a, b, metric)
    own, near = [], []
    for start in range(0, len(a), BYTE_ROWS):
        rows = slice(start, min(start + BYTE_ROWS, len(a)))
        for first in range(0, len(b), SLICE):
            some = slice(first, min(first + SLICE, len(b)))
            i = None
            if levels.useful:
                limit = max(own_most[rows][-1], near_most[some][-1])
                mask = levels.open_pairs(rows, some, limit)
                if np.count_nonzero(mask) <= MANY_OPEN * mask.size:
                    i, j = _set_places(mask)
                    gaps = _exact(a[rows], b[some], i, j, metric)
                    open_ = gaps <= np.maximum(own_most[start + i], near_most[first + j])
                    i, j = i[open_], j[open_]
            if i is None:
                i, j = np.nonzero(_distances(a[rows], b[some], metric) <= np.maximum(own_most[rows, None], near_most[some]))
            own.append(start + i)
            near.append(first + j)
    return orders[0][np.concatenate(own)], orders[1][np.concatenate(near)]


def _exact(queries, refs, own, near, metric: str) -> np.ndarray:
    """Distances of pairs, some at a time."""
    out = np.empty(len(own))
    for first in range(0, len(own), PAIR_ROWS):
        part = slice(first, first + PAIR_ROWS)
        out[part] = _length(refs[near[part]] - queries[own[part]], metric)
    return out


def _places(keys: pd.Series):
    """How many keys each reference has, where they begin, and all keys by their place in the order of the names."""
    many = keys.map(len).to_numpy()
    codes, names = pd.factorize(pd.Series([k for some in keys for k in some]), sort=True)
    return many, np.cumsum(many) - many, codes, names.to_numpy()


def _best_keys(own, near, gaps, places, rows: int, keep: int):
    """The ``keep`` best (query, key, distance) of each of so many queries, from pairs of a query and a reference."""
    many, offsets, codes, names = places
    # Each reference has a key at least: those beyond the last wanted distance have none among the best.
    some = gaps <= _renewed(np.full(rows, np.inf), own, gaps, keep)[own]
    own, near, gaps = own[some], near[some], gaps[some]
    times = many[near]
    place = np.repeat(offsets[near] - np.cumsum(times) + times, times) + np.arange(times.sum())
    own, gaps, key = np.repeat(own, times), np.repeat(gaps, times), codes[place]
    order = np.lexsort((key, gaps, own))
    ranks = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    order = order[ranks < keep]
    return own[order], names[key[order]], gaps[order]


def _both_kernel(keep: int, metric: str = "euclidean"):
    """Per row of either chunk the ``keep`` nearest (distance, key) pairs of the other within its radius."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"rep": [], "neighbor": [], "distance": []}
        if len(left) and len(right):
            vectors = [_matrix(side["vec"]) for side in (left, right)]
            radius = [side["radius"].to_numpy(float) for side in (left, right)]
            pairs = _near_both_by_levels(*vectors, *radius, metric) if metric in LEVELS else _near_both(*vectors, *radius)
            gaps = _exact(*vectors, *pairs, metric)
            for side, other, (own, near), limit in ((left, right, pairs, radius[0]), (right, left, pairs[::-1], radius[1])):
                some = gaps <= limit[own]
                own, key, gap = _best_keys(own[some], near[some], gaps[some], _places(other["keys"]), len(side), keep)
                found["rep"].append(side["rep"].to_numpy()[own])
                found["neighbor"].append(key)
                found["distance"].append(gap)
            found = {c: np.concatenate(v) for c, v in found.items()}
        return pd.DataFrame(found)

    return kernel


def _top_kernel(keep: int, axes=None, count: bool = False, metric: str = "euclidean"):
    """Per query the ``keep`` nearest (distance, key) pairs of one chunk; with ``count``, a row without a query
    says how many pairs there were and how many distances were summed to the end."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"rep": [], "neighbor": [], "distance": []}
        pairs, summed = 0, 0
        if len(left) and len(right):
            queries, refs = _matrix(left["vec"]), _matrix(right["vec"])
            reps = left["rep"].to_numpy()
            places = _places(right["keys"])
            radius = left["radius"].to_numpy(float) if "radius" in left else np.full(len(queries), np.inf)
            pairs = len(queries) * len(refs)
            if metric in LEVELS:
                candidates = _near_by_levels(queries, refs, metric, radius, keep)
            elif axes is None:
                candidates = _near_by_product(queries, refs, radius, keep)
            else:
                candidates = _near_candidates(queries, refs, axes, radius, keep)
            for start, own, near, full in candidates:
                summed += full
                gaps = _exact(queries, refs, own + start, near, metric)
                own, key, gaps = _best_keys(own, near, gaps, places, min(BLOCK, len(queries) - start), keep)
                found["rep"].append(reps[start + own])
                found["neighbor"].append(key)
                found["distance"].append(gaps)
            found = {c: np.concatenate(v) for c, v in found.items()}
        if not count:
            return pd.DataFrame(found)
        out = pd.DataFrame({c: pd.Series([*found[c], None], dtype=object) for c in found})
        out["pairs"], out["summed"] = 0, 0
        out.loc[len(out) - 1, ["pairs", "summed"]] = pairs, summed
        return out

    return kernel


def _best(candidates: DataFrame, by: str, keep: int) -> DataFrame:
    order = W.partitionBy(by).orderBy("distance", "neighbor")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def nearest_keys(index: Index, queries: DataFrame | None, key_type: str) -> DataFrame:
    """``(rep, neighbor, distance, rank)``: the ``index.keep`` nearest keys of each query vector; without queries, of each reference."""
    schema = f"rep {key_type}, neighbor {key_type}, distance double"
    return _best(_candidates(index, queries, schema, _top_kernel(index.keep, index.axes, metric=index.metric)), "rep", index.keep)


def search_work(index: Index, queries: DataFrame, key_type: str) -> DataFrame:
    """One row: pairs of the visited chunks, and those whose distances were summed over all coordinates."""
    schema = f"rep {key_type}, neighbor {key_type}, distance double, pairs long, summed long"
    found = _candidates(index, queries, schema, _top_kernel(index.keep, index.axes, count=True))
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "summed")))


def _candidates(index: Index, queries: DataFrame | None, schema: str, kernel) -> DataFrame:
    same = queries is None and index.axes is None
    base = (index.refs if queries is None else queries).select("rep", "vec", *["keys"] * same)
    if len(index.pivots) == 1:
        return _visit(index, base.withColumn("cells", F.array(F.lit(0))), kernel, schema, False)
    first = base.withColumn("cells", _home_cell(index)("vec"))
    second = _with_radius(base.withColumn("radius", F.lit(float("inf"))), _visit(index, first, kernel, schema, True), index.keep)
    second = second.withColumn("cells", _cells_within(index)("vec", "radius"))
    return _visit(index, second, kernel, schema, False, same)


def near_home(index: Index, queries: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs a kernel over one chunk of each query's closest cell; the work grows with the queries alone."""
    return _visit(index, queries.withColumn("cells", _home_cell(index)("vec")), kernel, schema, True)


def within_radius(index: Index, queries: DataFrame, radius: float, kernel, schema: str) -> DataFrame:
    """Runs a kernel over every chunk that may hold references within a fixed radius."""
    one = len(index.pivots) == 1
    cells = F.array(F.lit(0)) if one else _cells_within(index)("vec", F.lit(float(radius)))
    visits = queries.withColumn("cells", cells)
    return _visit(index, visits, kernel, schema, False)


def knn_work(queries: DataFrame, references: DataFrame, features, k: int, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What partial sums spare :func:`knn_join`: ``pairs`` visited, ``summed`` to the end, and their ``share``."""
    reference = materialize(distinct_points(points(references, features, key), k), "knn-references")
    index = build_index(reference, chunk_rows, keep=k)
    index.axes = variance_axes(reference)
    vectors = points(queries, features, key).groupBy("vec").agg(F.min("key").alias("rep"))
    work = search_work(index, materialize(vectors, "knn-queries"), references.schema[key].dataType.simpleString())
    share = F.when(F.col("pairs") > 0, F.col("summed") / F.col("pairs"))
    return work.select("pairs", "summed", share.alias("share"))


def _measured(rows: DataFrame, metric: str) -> DataFrame:
    """Points as a metric compares them: by cosine, vectors of length one."""
    if metric != "cosine":
        return rows
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sized = rows.withColumn("_length", length).filter("_length > 0")
    return sized.withColumn("vec", F.transform("vec", lambda x: x / F.col("_length"))).drop("_length")


def knn_join(
    queries: DataFrame,
    references: DataFrame,
    features,
    k: int,
    key: str,
    exclude_self: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    metric: str = "euclidean",
) -> DataFrame:
    """``(key, neighbor, distance, rank)``: the ``k`` nearest references of every query row.

    Ties are ordered by neighbour key. With ``exclude_self`` a row is not its own
    neighbour (copies of it still are). ``metric`` is one of ``METRICS``.
    """
    if metric not in METRICS:
        raise ModelError(f"unknown metric: {metric}")
    keep = k + 1 if exclude_self else k
    key_type = references.schema[key].dataType.simpleString()
    reference = materialize(distinct_points(_measured(points(references, features, key), metric), keep), "knn-references")
    index = build_index(reference, chunk_rows, keep=keep, metric=metric)
    if metric in ("euclidean", "cosine"):
        index.axes = _uneven_axes(reference)
    rows = _measured(points(queries, features, key), metric)
    if queries is references:
        vectors, found = reference.select("rep", "vec"), nearest_keys(index, None, key_type)
    else:
        vectors = materialize(rows.groupBy("vec").agg(F.min("key").alias("rep")), "knn-queries")
        found = nearest_keys(index, vectors, key_type)
    if metric == "cosine":
        found = found.withColumn("distance", F.col("distance") * F.col("distance") / 2)
    # Copies of a query share one search; AQE splits the join if one vector dominates.
    result = rows.join(vectors, "vec").select("key", "rep").join(found.drop("rank"), "rep").drop("rep")
    if exclude_self:
        result = result.filter(F.col("key") != F.col("neighbor"))
    return _best(result, "key", k).withColumnRenamed("key", key)
