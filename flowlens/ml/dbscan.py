"""Density clustering of any size of neighbourhood.

Points are first merged by value and placed in grid cells small enough that all points of
a cell are neighbours. A cell holding ``min_samples`` rows makes all its points core
without looking at any pair, and core points of a cell are connected by definition, so
clusters are the components of a graph of cells. Distances are computed in bounded tasks
(see ``neighbors``) that return counts or a spanning forest of the cells they saw, never point pairs.

Where points are dense, one chunk of a point's own neighbourhood shows that it is core, and such chunks together with
groups drawn by hash join most groups; all pairs are compared only for what these leave open.
"""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.ml.neighbors import BLOCK, CHUNK_ROWS, PAIR_ROWS, SLICE, _lower_bounds, _matrix, _set_places, build_index, near_home, points, within_radius
from flowlens.operators.preparation import fit_scaler
from flowlens.session import materialize

NOISE = -1
# Cluster roots numbered per task.
RANGE_ROWS = 100_000


def _near_blocks(left: pd.DataFrame, right: pd.DataFrame, eps: float):
    """Yields (query position, positions of references within eps) of one task."""
    queries, refs = _matrix(left["vec"]), _matrix(right["vec"])
    left_side, right_side, lengths, sizes, share, rest = _lower_bounds(queries, refs)
    # What bounds from above lack of the bounds from below, and rounding of the limits.
    slack = share * (eps * eps + lengths)
    spread = 2 * share * (lengths + sizes.max(initial=0.0))
    most = eps * eps + 2 * rest - (1 - share) * lengths + slack
    least = eps * eps - 2 * rest - (1 - share) * lengths - spread - slack
    for start in range(0, len(queries), BLOCK):
        block = slice(start, start + BLOCK)
        inside = np.zeros((len(queries[block]), len(refs)), bool)
        for first in range(0, len(refs), SLICE):
            bound = left_side[block] @ right_side[first : first + SLICE].T
            sure = bound <= least[block].astype(bound.dtype)[:, None]
            i, j = _set_places((bound <= most[block].astype(bound.dtype)[:, None]) & ~sure)
            for some in range(0, len(i), PAIR_ROWS):
                a, b = i[some : some + PAIR_ROWS], j[some : some + PAIR_ROWS]
                sure[a, b] = np.sqrt(((refs[first + b] - queries[start + a]) ** 2).sum(axis=1)) <= eps
            inside[:, first : first + SLICE] = sure
        for i, row in enumerate(inside):
            yield start + i, np.flatnonzero(row)


def _count_kernel(eps: float):
    """Per query the number of rows within eps in one chunk."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        reps, counts = [], []
        if len(left) and len(right):
            weight, names = right["weight"].to_numpy(), left["rep"].tolist()
            for i, inside in _near_blocks(left, right, eps):
                reps.append(names[i])
                counts.append(int(weight[inside].sum()))
        return pd.DataFrame({"rep": reps, "n": np.array(counts, dtype="int64")})

    return kernel


def _edge_kernel(eps: float):
    """A spanning forest of the groups that have points within eps of each other in one chunk.

    Groups are united inside the task, so a task sends fewer edges than it has points, however
    many pairs lie within eps.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, root = [], np.zeros(0, int)
        if len(left) and len(right):
            codes, names = pd.factorize(pd.concat([left["group"], right["group"]]), sort=True)
            own, other = codes[: len(left)], codes[len(left) :]
            root = np.arange(len(names))
            for i, inside in _near_blocks(left, right, eps):
                met = np.unique(np.append(root[other[inside]], root[own[i]]))
                if len(met) > 1:
                    # Names are sorted: a tree's root is its smallest group.
                    root[np.isin(root, met)] = met[0]
        child = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": [names[k] for k in root[child]], "b": [names[k] for k in child]})

    return kernel


def _border_kernel(eps: float):
    """Per query the first cluster with a core point within eps in one chunk."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        reps, roots = [], []
        if len(left) and len(right):
            names, root = left["rep"].tolist(), right["root"].to_numpy()
            for i, inside in _near_blocks(left, right, eps):
                if len(inside):
                    reps.append(names[i])
                    roots.append(min(root[inside]))
        return pd.DataFrame({"rep": reps, "root": roots})

    return kernel


def _fingerprint(edges: DataFrame):
    """Number and hash sum of the edges; equal when a round changed nothing."""
    code = F.xxhash64("a", "b").cast("decimal(38,0)")
    return edges.agg(F.count("*").alias("n"), F.sum(code).alias("h")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each component, for ``(a, b)`` edges.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need about
    log(n) rounds; every round is written out, so lineage stays short and lost executors
    cost one round.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct(),
        "components",
    )
    state, before = _fingerprint(edges), None
    while state["n"] and state != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours of a node move to the smallest of it and its neighbours.
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(smallest, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        edges = materialize(small, "components")
        state, before = _fingerprint(edges), state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)


def eps_neighbors(df: DataFrame, features, key: str, eps: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n_neighbors)``: rows within eps of each row, itself included."""
    rows = points(df, features, key)
    distinct = rows.groupBy("vec").agg(F.min("key").alias("rep"), F.count("*").alias("weight"))
    distinct = materialize(distinct, "eps-points")
    key_type = df.schema[key].dataType.simpleString()
    index = build_index(distinct, chunk_rows)
    counts = within_radius(
        index, distinct.select("rep", "vec"), eps, _count_kernel(eps), f"rep {key_type}, n bigint"
    )
    totals = counts.groupBy("rep").agg(F.sum("n").alias("n_neighbors"))
    named = rows.join(distinct.select("vec", "rep"), "vec").select("key", "rep")
    return named.join(totals, "rep").select(F.col("key").alias(key), "n_neighbors")


def dbscan(
    df: DataFrame,
    features,
    key: str,
    eps: float = 0.5,
    min_samples: int = 5,
    scale: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(key, cluster)``; clusters are numbered by their smallest core key, noise is -1.

    A border row within reach of several clusters joins the lowest-numbered one.
    """
    if scale:
        df = fit_scaler(df, features).transform(df)
    key_type = df.schema[key].dataType.simpleString()
    rows = points(df, features, key)
    dims = len(rows.select("vec").first()["vec"])
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    distinct = rows.groupBy("vec").agg(F.min("key").alias("rep"), F.count("*").alias("weight"))
    cell = F.transform("vec", lambda x: F.floor(x / F.lit(side)).cast("bigint"))
    distinct = distinct.withColumn("grid", cell)
    dense = distinct.groupBy("grid").agg(F.sum("weight").alias("grid_weight"))
    distinct = materialize(distinct.join(dense, "grid"), "dbscan-points")

    packed = F.col("grid_weight") >= min_samples
    index = build_index(distinct.select("rep", "vec", "weight"), chunk_rows)
    sparse = distinct.filter(~packed).select("rep", "vec")
    core_sparse = _dense_points(index, sparse, eps, min_samples, key_type)
    core = distinct.filter(packed).unionByName(distinct.join(core_sparse, "rep", "left_semi"))
    group = core.groupBy("grid").agg(F.min("rep").alias("group"))
    core = materialize(core.join(group, "grid").select("rep", "vec", "group"), "dbscan-core")

    core_index = build_index(core, chunk_rows)
    roots = _rooted(core_index, core, eps, chunk_rows, key_type)

    border = distinct.join(core.select("rep"), "rep", "left_anti").select("rep", "vec")
    # The same vectors in the same cells, now with their cluster root.
    rooted = core_index.refs.join(roots.select("rep", "root"), "rep")
    root_index = replace(core_index, refs=rooted)
    reached = (
        within_radius(root_index, border, eps, _border_kernel(eps), f"rep {key_type}, root {key_type}")
        .groupBy("rep")
        .agg(F.min("root").alias("root"))
    )
    labels = number_clusters(roots.select("root").distinct())
    assigned = roots.select("rep", "root").unionByName(reached).join(labels, "root").select("rep", "cluster")
    named = rows.join(distinct.select("vec", "rep"), "vec").select("key", "rep")
    return named.join(assigned, "rep", "left").select(
        F.col("key").alias(key), F.coalesce("cluster", F.lit(NOISE)).alias("cluster")
    )


def _dense_points(index, queries: DataFrame, eps: float, min_samples: int, key_type: str) -> DataFrame:
    """``(rep)`` of the queries with ``min_samples`` rows within eps: those that one chunk does not show are counted in full."""
    schema = f"rep {key_type}, n bigint"

    def enough(counted):
        return counted.groupBy("rep").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("rep")

    if len(index.pivots) == 1:
        return enough(within_radius(index, queries, eps, _count_kernel(eps), schema))
    shown = materialize(enough(near_home(index, queries, _count_kernel(eps), schema)), "dbscan-shown")
    open_ = queries.join(shown, "rep", "left_anti")
    return shown.unionByName(enough(within_radius(index, open_, eps, _count_kernel(eps), schema)))


def _rooted(index, core: DataFrame, eps: float, chunk_rows: int, key_type: str) -> DataFrame:
    """``(rep, vec, root)`` of the core points: the smallest group of each cluster.

    Two clusters found so far can only meet in a pair of which one point lies outside the largest of them, so only
    those points are compared with all others.
    """
    kernel, schema = _edge_kernel(eps), f"a {key_type}, b {key_type}"

    def joined(rows, edges):
        roots = connected_components(edges.distinct()).withColumnRenamed("node", "group")
        roots = rows.join(roots, "group", "left").select("rep", "vec", F.coalesce("root", "group").alias("root"))
        return materialize(roots, "dbscan-roots")

    if len(index.pivots) == 1:
        return joined(core, within_radius(index, core, eps, kernel, schema))
    draws = max(1, int(index.sizes.sum()) // chunk_rows)
    drawn = core.withColumn("draw", F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(draws)))
    drawn = drawn.groupBy("draw").applyInPandas(lambda frame: kernel(frame, frame), schema)
    found = joined(core, near_home(index, core, kernel, schema).unionByName(drawn))
    largest = found.groupBy("root").count().orderBy(F.desc("count"), "root").first()
    rest = found.filter(~F.col("root").eqNullSafe(F.lit(largest["root"]))) if largest else found
    if rest.isEmpty():
        return found
    grouped = index.refs.drop("group").join(found.select("rep", F.col("root").alias("group")), "rep")
    edges = within_radius(replace(index, refs=grouped), rest.withColumnRenamed("root", "group"), eps, kernel, schema)
    return joined(found.withColumnRenamed("root", "group"), edges)


def number_clusters(roots: DataFrame) -> DataFrame:
    """``(root, cluster)``: 0-based rank of each root.

    Ranked inside value ranges; the offsets hold one row per range.
    """
    roots = materialize(roots, "cluster-roots")
    parts = 1 + roots.count() // RANGE_ROWS
    spread = materialize(
        roots.repartitionByRange(parts, "root").withColumn("_part", F.spark_partition_id()), "cluster-ranges"
    )
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy("_part").orderBy("root")
    return spread.join(F.broadcast(offsets), "_part").select(
        "root", (F.row_number().over(inside) - 1 + F.col("_o")).cast("int").alias("cluster")
    )
