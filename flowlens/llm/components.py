"""Connected components of large graphs by rounds of star contraction.

Each task first links its own edges with a union-find and passes on a forest of stars; rounds of
large and small stars then hang every node on smaller neighbours until all hang on the smallest.
Every round is a table in the shared folder, so lineage stays short and lost executors only cost
the round's own work. Nodes with very many edges are pre-aggregated by the minimum, and joins on
them are split by Spark where they are skewed. Nothing is brought to the driver but a checksum.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

#: Edges of one union-find in a task; more are passed on in several parts.
LOCAL_EDGES = 1 << 20


class Forest:
    """Union-find over node numbers; roots are the smallest nodes."""

    def __init__(self, nodes: int):
        self.parent = list(range(nodes))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) for all nodes of the edges that are not the smallest of their part."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        forest.link(x, y)
    root = np.array([forest.find(x) for x in range(len(nodes))], np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    held, size = [], 0

    def flush():
        a, b = star_edges(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, not null); component is its smallest node."""
    edges = edges.select("a", "b").where("a != b").mapInArrow(_contract, "a long, b long")
    edges = materialize(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a != b").distinct(), "edges")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
