"""Isolation forest: trees are built in parallel from small samples, scoring is one pass."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.ml.neighbors import points
from flowlens.operators.ordering import exact_quantiles, sample_rows
from flowlens.schemas import SEED
from flowlens.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, threshold double, lower int, upper int, depth double"
LEAF = -1


def path_adjustment(rows: float) -> float:
    """Mean path length of an unsuccessful search among ``rows`` values."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def _grow(matrix: np.ndarray, random: np.random.RandomState, limit: int):
    """Nodes of one tree; a leaf's depth includes the adjustment for its rows."""
    nodes, pending = [], [(0, np.arange(len(matrix)), 0)]
    count = 1
    while pending:
        node, rows, depth = pending.pop()
        values = matrix[rows]
        low, high = values.min(axis=0), values.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            nodes.append((node, LEAF, 0.0, LEAF, LEAF, depth + path_adjustment(len(rows))))
            continue
        feature = int(random.choice(splittable))
        threshold = float(random.uniform(low[feature], high[feature]))
        goes_low = values[:, feature] <= threshold
        nodes.append((node, feature, threshold, count, count + 1, float(depth)))
        pending.append((count, rows[goes_low], depth + 1))
        pending.append((count + 1, rows[~goes_low], depth + 1))
        count += 2
    return nodes


@dataclass
class IsolationForest:
    """Node table of all trees (bounded by trees x sample size) and the score threshold."""

    nodes: list
    features: list
    key: str
    sample: int
    threshold: float | None = None
    training_scores: DataFrame | None = field(default=None, repr=False)

    def scorer(self):
        """Function from a matrix to scores; lower is more anomalous."""
        table = pd.DataFrame(self.nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
        trees = []
        for _, tree in table.sort_values(["tree", "node"]).groupby("tree"):
            trees.append(tuple(tree[c].to_numpy() for c in ("feature", "threshold", "lower", "upper", "depth")))
        scale = path_adjustment(self.sample) or 1.0

        def score(matrix: np.ndarray) -> np.ndarray:
            total, rows = np.zeros(len(matrix)), np.arange(len(matrix))
            for feature, threshold, lower, upper, depth in trees:
                at = np.zeros(len(matrix), dtype=int)
                while True:
                    inner = feature[at] != LEAF
                    if not inner.any():
                        break
                    moving, place = rows[inner], at[inner]
                    low = matrix[moving, feature[place]] <= threshold[place]
                    at[moving] = np.where(low, lower[place], upper[place])
                total += depth[at]
            return -np.power(2.0, -total / len(trees) / scale)

        return score

    def score(self, df: DataFrame) -> DataFrame:
        """``(key, raw)`` per row without missing features."""
        forest = df.sparkSession.sparkContext.broadcast(self.nodes)
        shell = IsolationForest([], self.features, self.key, self.sample)

        @F.pandas_udf("double")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shell.nodes = forest.value
            score = shell.scorer()
            for vec in batches:
                yield pd.Series(score(np.array(list(vec), dtype=float)) if len(vec) else [], dtype=float)

        return points(df, self.features, self.key).select(
            F.col("key").alias(self.key), raw("vec").alias("raw")
        )


def fit_isolation_forest(
    df: DataFrame,
    features,
    key: str,
    contamination: float = 0.1,
    trees: int = 100,
    max_samples: int = 256,
    seed: int = SEED,
) -> IsolationForest:
    """Samples by key hash, so the forest does not depend on partitioning.

    One pool of at most trees x sample rows is drawn from the table; every tree takes its
    own sample of the pool and is grown in its own task.
    """
    features = [features] if isinstance(features, str) else list(features)
    pool = materialize(
        sample_rows(points(df, features, key), "key", trees * max_samples, seed), "forest-pool"
    )
    size = pool.count()
    sample = min(max_samples, size)
    per_tree = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = F.xxhash64(F.col("key").cast("string"), F.col("tree"), F.lit(seed))
    per_tree = per_tree.withColumn("_h", draw)
    margin = (sample + 6 * sample**0.5) / max(size, 1)
    if margin < 1:
        # Only the lower hashes can be drawn; six deviations of slack keep samples full.
        per_tree = per_tree.filter(F.pmod("_h", F.lit(1_000_003)) < int(margin * 1_000_003))
    order = W.partitionBy("tree").orderBy(F.pmod("_h", F.lit(1_000_003)), "_h", "key")
    drawn = per_tree.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        matrix = np.array(part.sort_values("key")["vec"].tolist(), dtype=float)
        nodes = _grow(matrix, np.random.RandomState(seed * 1000 + tree), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    nodes = drawn.select("tree", "key", "vec").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    model = IsolationForest([tuple(r) for r in nodes.collect()], features, key, sample)
    model.training_scores = materialize(model.score(df), "forest-scores")
    model.threshold = exact_quantiles(model.training_scores, ["raw"], [contamination])["raw"][0]
    return model


def anomaly_attribution(
    model: IsolationForest,
    df: DataFrame,
    permutations: int = 8,
    background: int = 100,
    seed: int = SEED,
) -> DataFrame:
    """``(key, feature, contribution)``: how each feature moves a row's score.

    Shapley values by permutation sampling: a background row is changed into the explained
    one, feature by feature in a random order, and score changes are averaged; there are at
    least ``permutations`` such rounds, and one for every background row. Contributions of a row add up
    to its score minus the mean score of the background rows it was compared with. The
    background holds at most ``background`` rows; all rows of ``df`` are explained.
    """
    features = model.features
    drawn = sample_rows(points(df, features, model.key), "key", background, seed).collect()
    reference = np.array([r["vec"] for r in drawn], dtype=float)
    random = np.random.RandomState(seed)
    rounds = max(permutations, len(reference))  # every background row takes part
    plan = [(random.permutation(len(features)), reference[i % len(reference)]) for i in range(rounds)]
    nodes = df.sparkSession.sparkContext.broadcast(model.nodes)
    shell = IsolationForest([], features, model.key, model.sample)

    @F.pandas_udf("array<double>")
    def contributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shell.nodes = nodes.value
        score = shell.scorer()
        for vec in batches:
            target = np.array(list(vec), dtype=float).reshape(len(vec), len(features))
            total = np.zeros_like(target)
            for order, start in plan if len(vec) else ():
                current = np.tile(start, (len(target), 1))
                before = score(current)
                for feature in order:
                    current[:, feature] = target[:, feature]
                    after = score(current)
                    total[:, feature] += after - before
                    before = after
            yield pd.Series(list(total / len(plan)), dtype=object)

    names = F.array(*[F.lit(f) for f in features])
    explained = points(df, features, model.key).withColumn("c", contributions("vec"))
    cells = F.explode(F.arrays_zip(names.alias("feature"), F.col("c").alias("contribution")))
    return explained.select(F.col("key").alias(model.key), cells.alias("x")).select(
        model.key, F.col("x.feature"), F.col("x.contribution")
    )


def attribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
    )
