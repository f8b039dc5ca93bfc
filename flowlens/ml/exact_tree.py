"""Decision tree with exact splits: every distinct value of every feature is looked at, level by level.

Values are cut once into ranges of about equal numbers of rows. At each level the rows of open nodes are counted by
(node, feature, range, value, label); label counts up to a value are the sum of the ranges before (a small table,
one row a node, feature and range) and a running sum inside the range. No task sorts more than one range of one
feature of one node, and only the best split of each node reaches the driver.

Impurity is Gini's. An impure node is split by the best split there is, even one that gains nothing; the threshold lies
halfway between two values. Equal gains go to the feature named first, then to the smaller value. Rows
with missing features are left out.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.errors import ModelError
from flowlens.session import materialize

LEAF = -1
RANGES = 256
# The node table is the model and is held by the driver and every task.
MAX_NODES = 1 << 18


@dataclass
class ExactTree:
    """Nodes by number, the root first: split feature (-1 for leaves), threshold, children, label counts."""

    names: list
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    lower: list = field(default_factory=list)
    upper: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    depth: list = field(default_factory=list)

    def add(self, counts, depth: int) -> int:
        if len(self.feature) >= MAX_NODES:
            raise ModelError(f"the tree has more than {MAX_NODES} nodes; limit its depth or the rows of a leaf")
        for values, value in zip(
            (self.feature, self.threshold, self.lower, self.upper, self.counts, self.depth),
            (LEAF, 0.0, LEAF, LEAF, [int(c) for c in counts], depth),
        ):
            values.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, lower_counts) -> tuple[int, int]:
        """Children of a node that becomes a split."""
        rest = [a - b for a, b in zip(self.counts[node], lower_counts)]
        self.feature[node], self.threshold[node] = int(feature), float(threshold)
        self.lower[node] = self.add(lower_counts, self.depth[node] + 1)
        self.upper[node] = self.add(rest, self.depth[node] + 1)
        return self.lower[node], self.upper[node]

    def place(self, matrix: np.ndarray) -> np.ndarray:
        """Number of the leaf each row falls into."""
        feature, threshold, lower, upper = (np.array(x) for x in (self.feature, self.threshold, self.lower, self.upper))
        at = np.zeros(len(matrix), dtype=int)
        moving = np.flatnonzero(feature[at] != LEAF)
        while len(moving):
            node = at[moving]
            low = matrix[moving, feature[node]] <= threshold[node]
            at[moving] = np.where(low, lower[node], upper[node])
            moving = moving[feature[at[moving]] != LEAF]
        return at

    def leaf(self, spark, vec: Column, wanted) -> Column:
        """Leaf of an array column of features, -1 if it is none of those wanted."""
        shared, number = spark.sparkContext.broadcast(self), np.full(self.numNodes, LEAF, np.int32)
        number[sorted(wanted)] = sorted(wanted)

        @F.pandas_udf("int")
        def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tree = shared.value
            for batch in batches:
                matrix = np.array(list(batch), dtype=float).reshape(len(batch), len(tree.names))
                yield pd.Series(number[tree.place(matrix)], dtype="int32")

        return leaf_of(vec)

    def shares(self, spark, vec: Column) -> Column:
        """Shares of the labels in the leaf a row falls into."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def shares_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tree = shared.value
            counts = np.array(tree.counts, dtype=float)
            table = counts / counts.sum(axis=1, keepdims=True)
            for batch in batches:
                matrix = np.array(list(batch), dtype=float).reshape(len(batch), len(tree.names))
                yield pd.Series(list(table[tree.place(matrix)]), dtype=object)

        return shares_of(vec)

    def table(self, spark) -> DataFrame:
        """One row a split: node, feature, threshold, rows, lower_rows, and the decrease of impurity times rows."""
        rows = [
            (i, self.names[f], self.threshold[i], sum(self.counts[i]), sum(self.counts[self.lower[i]]), self._decrease(i))
            for i, f in enumerate(self.feature) if f != LEAF
        ]
        return spark.createDataFrame(rows, "node int, feature string, threshold double, rows long, lower_rows long, decrease double")

    def _decrease(self, node: int) -> float:
        return _purity(self.counts[self.lower[node]]) + _purity(self.counts[self.upper[node]]) - _purity(self.counts[node])

    @property
    def numNodes(self) -> int:
        return len(self.feature)

    @property
    def featureImportances(self) -> DenseVector:
        total = np.zeros(len(self.names))
        for i, f in enumerate(self.feature):
            if f != LEAF:
                total[f] += self._decrease(i)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    @property
    def toDebugString(self) -> str:
        lines, stack = [], [(0, "")]
        while stack:
            node, condition = stack.pop()
            pad = " " * self.depth[node]
            if condition:
                lines.append(f"{pad}{condition}")
            if self.feature[node] == LEAF:
                lines.append(f"{pad} Predict: {float(np.argmax(self.counts[node]))}")
            else:
                test = f"If (feature {self.feature[node]} {{}} {self.threshold[node]})"
                stack += [(self.upper[node], test.format(">")), (self.lower[node], test.format("<="))]
        return "\n".join(lines)


def _purity(counts) -> float:
    return sum(float(c) * float(c) for c in counts) / sum(counts) if sum(counts) else 0.0


def fit_exact_tree(
    vectors: DataFrame, names, labels: int, max_depth: int | None = None, min_samples_split: int = 2,
    min_samples_leaf: int = 1, ranges: int = RANGES,
) -> ExactTree:
    """Tree over ``(vec, label)``: an array of features and a label from 0 to ``labels`` - 1."""
    spark = vectors.sparkSession
    columns = [f"c{i}" for i in range(len(names))]
    wide = vectors.select(F.col("label").cast("int").alias("label"), *[F.col("vec")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    wide = materialize(wide.na.drop(), "tree-rows")
    steps = [i / ranges for i in range(1, ranges)]
    found = wide.agg(
        *[F.count_if(F.col("label") == i).alias(f"n{i}") for i in range(labels)],
        *[F.percentile_approx(c, steps).alias(c) for c in columns],
    ).first()
    tree = ExactTree(list(names))
    totals = [found[f"n{i}"] for i in range(labels)]
    root = tree.add(totals, 0)
    if not sum(totals):
        raise ModelError("no rows without missing features")
    splits = [[-float("inf"), *sorted({x for x in found[c] if abs(x) != float("inf")}), float("inf")] for c in columns]
    cut = Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"r{i}" for i in range(len(columns))]).transform(wide)
    cells = [F.struct(F.lit(i).alias("feature"), F.col(f"r{i}").cast("int").alias("part"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    rows = materialize(cut.select("label", F.array(*columns).alias("vec"), F.array(*cells).alias("cells")), "tree-cells")

    def splittable(node):
        counts = tree.counts[node]
        deep = max_depth is not None and tree.depth[node] >= max_depth
        return not deep and sum(counts) >= max(min_samples_split, 2 * min_samples_leaf, 2) and max(counts) < sum(counts)

    pending = {root} if splittable(root) else set()
    while pending:
        best = _best_splits(rows, tree, pending, labels, min_samples_leaf)
        pending = {child for r in best for child in tree.split(r["node"], r["feature"], r["threshold"], r["lower"]) if splittable(child)}
    return tree


def _best_splits(rows: DataFrame, tree: ExactTree, pending: set, labels: int, least: int) -> list:
    """One row for each of the open nodes that can be split, in order of their numbers."""
    sums = [f"n{i}" for i in range(labels)]
    placed = rows.withColumn("node", tree.leaf(rows.sparkSession, F.col("vec"), pending)).filter(F.col("node") != LEAF)
    listed = placed.select("node", "label", F.explode("cells").alias("cell")).select("node", "label", "cell.*")
    counted = materialize(
        listed.groupBy("node", "feature", "part", "value").agg(*[F.count_if(F.col("label") == i).alias(n) for i, n in enumerate(sums)]),
        "tree-counts",
    )
    whole = W.partitionBy("node", "feature")
    earlier = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = counted.groupBy("node", "feature", "part").agg(F.min("value").alias("first"), *[F.sum(n).alias(n) for n in sums])
    parts = parts.select(
        "node", "feature", "part", F.lead("first").over(whole.orderBy("part")).alias("beyond"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in sums],
    )
    inside = W.partitionBy("node", "feature", "part").orderBy("value")
    running = counted.join(parts, ["node", "feature", "part"]).select(
        "node", "feature", "value", F.coalesce(F.lead("value").over(inside), "beyond").alias("following"),
        F.array(*[F.col(f"before_{n}") + F.sum(n).over(inside.rowsBetween(W.unboundedPreceding, 0)) for n in sums]).alias("lower"),
        F.array(*[F.col(f"all_{n}") for n in sums]).alias("every"),
    )
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    upper = F.zip_with("every", "lower", lambda a, b: a - b)
    split = running.filter("following is not null").select(
        "node", "feature", "value", "following", "lower", upper.alias("upper"), total("lower").alias("n_lower"), total(upper).alias("n_upper")
    ).filter((F.col("n_lower") >= least) & (F.col("n_upper") >= least))
    middle = F.col("value") / 2 + F.col("following") / 2
    split = split.withColumn("gain", squares("lower") / F.col("n_lower") + squares("upper") / F.col("n_upper"))
    split = split.withColumn("threshold", F.when((middle < F.col("following")) & (middle >= F.col("value")), middle).otherwise(F.col("value")))
    chosen = F.max_by(F.struct("feature", "threshold", "lower"), F.struct("gain", -F.col("feature"), -F.col("value")))
    return split.groupBy("node").agg(chosen.alias("best")).select("node", "best.*").orderBy("node").collect()
