"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of few dimensions. Two
vectors whose squared distance is at most d differ, in at least one block, by at most that
block's share of d. So every block is range-joined by itself: a vector has its home in a grid
cell over the block's leading coordinates and visits all cells within the block's radius, and in
a cell the residents meet residents and visitors. Pairs within the block's share are verified by
their cosine in double precision; a pair that several blocks find counts in the first.

Equal vectors are joined once, with the number of their copies. Cells with many residents are cut
into parts, each of which streams past all the cell's vectors, so a task's memory is one part;
links are counted where the residents are and never listed.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
null labels and null ids (whose component is null and which are not kept); vectors of different
lengths never link. Rows of one id are one node, their links counted for each row. Columns of
any other name are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import components, star_edges
from flowlens.llm.wordscan import mix
from flowlens.session import materialize

BLOCKS = 8
GRID = 3
SIDE = 4.0
PART_VECTORS = 1_024
VISITORS = 128
SLACK = 1e-9


def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    turn, triangle = np.linalg.qr(np.random.default_rng(20_240_229).normal(size=(dimensions, dimensions)))
    return turn * np.sign(np.diag(triangle))


def block_edges(dimensions: int) -> np.ndarray:
    return np.linspace(0, dimensions, min(BLOCKS, dimensions) + 1).astype(int)


def budget(cosine: float, dimensions: int) -> np.ndarray:
    """Each block's share of the squared distance of unit vectors at the least cosine."""
    return np.diff(block_edges(dimensions)) / dimensions * 2 * (1 - cosine) + SLACK


def units(raw: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _cell_code(label: np.ndarray, number: int, at: np.ndarray) -> np.ndarray:
    code = mix(label.view(np.uint64) + mix(np.array([number], np.uint64)))
    for j in range(at.shape[1]):
        code = mix(code + at[:, j].astype(np.int64).view(np.uint64))
    return code.view(np.int64)


def _place(cosine: float, kind: str):
    """Each vector's home cell and the cells it visits, for every block."""

    def run(batches):
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in raw])
            for dimensions in np.unique(sizes):
                own = np.flatnonzero(sizes == dimensions)
                for cut in np.array_split(own, -(-len(own) // 2048)):
                    yield from _place_some(batch.take(pa.array(cut)), int(dimensions), cosine, kind)

    return run


def _place_some(batch, dimensions: int, cosine: float, kind: str):
    vectors = units(batch.column("vector").to_pylist(), kind) @ rotation(dimensions)
    label = batch.column("label").to_numpy() * np.int64(1_000_003) + dimensions
    edges, shares = block_edges(dimensions), budget(cosine, dimensions)
    for b, share in enumerate(shares):
        lead = vectors[:, edges[b] : min(edges[b] + GRID, edges[b + 1])]
        radius = np.sqrt(share)
        side = SIDE * radius
        home = np.floor(lead / side)
        low, high = np.floor((lead - radius) / side), np.floor((lead + radius) / side)
        row, at = np.arange(len(lead)), home
        for j in range(lead.shape[1]):  # one more place for each coordinate whose range crosses a wall
            for shift in (low, high):
                cross = np.flatnonzero((shift[row, j] != home[row, j]) & (at[:, j] == home[row, j]))
                moved = at[cross].copy()
                moved[:, j] = shift[row[cross], j]
                row, at = np.concatenate([row, row[cross]]), np.concatenate([at, moved])
        visit = (at != home[row]).any(axis=1)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_cell_code(label[row], b, at)), batch.column("group").take(take), batch.column("copies").take(take),
             pa.array(visit.astype(np.int32)), pa.array(np.full(len(row), b, np.int32)), batch.column("vector").take(take)],
            ["cell", "group", "copies", "visit", "number", "vector"],
        )


def _join(cosine: float, kind: str):
    """Streams the vectors of a cell past the residents of one of its parts."""

    def run(batches):
        current, held, work = None, [], None
        for batch in batches:
            frame = batch.to_pandas()
            edges = np.flatnonzero((frame["cell"].diff() != 0) | (frame["part"].diff() != 0))
            for a, b in zip(edges, [*edges[1:], len(frame)]):
                rows = frame.iloc[a:b]
                at = (rows["cell"].iloc[0], rows["part"].iloc[0])
                if at != current:
                    if held:
                        yield from (work or _Cell(held, cosine, kind)).out()
                    current, held, work = at, [], None
                residents, others = rows[rows["side"] == 0], rows[rows["side"] == 1]
                if len(residents):
                    held.append(residents)
                if len(others) and work is None and held:
                    work = _Cell(held, cosine, kind)
                if len(others):
                    for c in range(0, len(others) if work else 0, VISITORS):
                        work.meet(others.iloc[c : c + VISITORS])
        if held:
            yield from (work or _Cell(held, cosine, kind)).out()

    return run


class _Cell:
    def __init__(self, frames: list, cosine: float, kind: str):
        self.cosine, self.kind = cosine, kind
        self.raw = [x for f in frames for x in f["vector"]]
        self.group = np.concatenate([f["group"].to_numpy() for f in frames])
        self.number = int(frames[0]["number"].iloc[0])
        self.unit = units(self.raw, kind)
        self.dimensions = self.unit.shape[1]
        self.turned = self.unit @ rotation(self.dimensions)
        self.edges, self.shares = block_edges(self.dimensions), budget(cosine, self.dimensions)
        self.links = np.zeros(len(self.raw), np.int64)
        self.pairs = [(self.group, self.group)]
        if frames[0]["parts"].iloc[0] == 1:
            copies = np.concatenate([f["copies"].to_numpy() for f in frames])
            for c in range(0, len(self.raw), VISITORS):
                part = slice(c, c + VISITORS)
                self._meet(self.unit[part], self.turned[part], self.group[part], copies[part])

    def meet(self, others):
        unit = units(others["vector"].tolist(), self.kind)
        self._meet(unit, unit @ rotation(self.dimensions), others["group"].to_numpy(), others["copies"].to_numpy())

    def _meet(self, unit, turned, other, copies):
        a, b = self.edges[self.number], self.edges[self.number + 1]
        x, y = self.turned[:, a:b], turned[:, a:b]
        apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        i, j = np.nonzero(apart <= self.shares[self.number] + SLACK)
        i, j = i[self.group[i] != other[j]], j[self.group[i] != other[j]]
        squares = np.add.reduceat((self.turned[i] - turned[j]) ** 2, self.edges[:-1], axis=1)
        within = squares <= self.shares
        found = within.any(axis=1) & (within.argmax(axis=1) == self.number)
        i, j = i[found], j[found]
        linked = (self.unit[i] * unit[j]).sum(axis=1) >= self.cosine
        i, j = i[linked], j[linked]
        np.add.at(self.links, i, copies[j])
        self.pairs.append((self.group[i], other[j]))
        if sum(len(p) for p, _ in self.pairs) > 1 << 18:
            self.pairs = [star_edges(*(np.concatenate(x) for x in zip(*self.pairs)))]

    def out(self):
        node, root = star_edges(*(np.concatenate(x) for x in zip(*self.pairs)))
        group = np.concatenate([self.group, node])
        links = np.concatenate([self.links, np.zeros(len(node), np.int64)])
        other = np.concatenate([self.group, root])
        yield pa.RecordBatch.from_pydict({"group": group, "links": links, "other": other})


def _usable(kind: str):
    """Bytes of each vector, or null where it links with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_pylist():
                v = np.array(x, kind) if x and None not in x else np.zeros(1)
                square = np.square(v.astype(np.float64)).sum()
                out.append(v.tobytes() if np.isfinite(square) and square > 0 else None)
            at = batch.schema.get_field_index("embedding")
            yield batch.set_column(at, pa.field("vector", pa.binary()), pa.array(out, pa.binary()))

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reached), kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = materialize(rows.mapInArrow(_usable(kind), "id long, label long, vector binary"), "vectors")
    usable = rows.where("id is not null and label is not null and vector is not null")
    groups = usable.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("id").alias("copies"))
    # equal vectors under two labels may share their smallest id: a hash of both names the group
    groups = materialize(groups.withColumn("group", F.xxhash64("label", "vector")), "groups")
    placed = materialize(groups.select("group", "label", "copies", "vector").mapInArrow(
        _place(cosine, kind), "cell long, group long, copies long, visit int, number int, vector binary"), "cells")
    met = placed.groupBy("cell").agg(F.count("group").alias("all"), F.sum(1 - F.col("visit")).alias("residents"))
    met = met.where("residents > 0 and all > 1").select("cell", F.ceil(F.col("residents") / PART_VECTORS).alias("parts"))
    placed = placed.join(met, "cell")
    resident = placed.where("visit = 0").select(
        "cell", F.pmod(F.col("group"), F.col("parts")).alias("part"), F.lit(0).alias("side"), "group", "copies", "number", "parts", "vector")
    other = placed.where("visit = 1 or parts > 1").select(  # residents of a single part meet each other there
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "group", "copies", "number", "parts", "vector")
    dealt = resident.unionByName(other).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
    found = materialize(dealt.mapInArrow(_join(cosine, kind), "group long, links long, other long"), "found")
    links = found.groupBy("group").agg(F.sum("links").alias("links"))
    firsts = groups.select("group", "first")
    edges = found.where("group != other").join(firsts, "group").select(F.col("first").alias("x"), "other")
    edges = edges.join(firsts.withColumnRenamed("group", "other"), "other").select(F.col("x").alias("a"), F.col("first").alias("b"))
    named = groups.join(links, "group", "left").select("label", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = rows.join(named, ["label", "vector"], "left")
    copies = usable.join(groups, ["label", "vector"]).where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    reached = components(edges.union(copies))
    out = known.join(reached, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
