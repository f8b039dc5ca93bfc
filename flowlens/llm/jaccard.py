"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles. Documents with the same set are one class;
only the class's smallest id takes part in the join, its copies keep its component.

Shingles are hashed into groups, and a document's group counts are a point. Two sets share at most
the sum of the smaller counts over all groups, which bounds the overlap of points, and of a point
and any box of points, from above.

The index has two levels. Above, spread over the cluster, points meet in cells: sets that may link
differ in at most D shingles (D follows from the sizes), so of D + 1 + m groups at least m + 1
hold the same shingles, and a cell is a size band, a group and the shingles in it. Cells of one
document alone are dropped by a count-min sketch. Below, in a task, the points of a cell are packed
into an R-tree and searched with the bound. Surviving pairs are verified on their whole sets.

Pairs that the points do not rule out meet a second bound before any text moves: each set also has
a vector of as many two-valued groups as it has shingles (counts modulo two). Groups in which two
such vectors differ hold a shingle that only one of the sets has, so their number is never more
than the sets' difference. Vectors fold to the shorter one's length; ``PARITY_BITS`` bounds them,
beyond which the bound is weaker, never wrong. Pairs of the tree meet it in the cell's task, on vectors
folded to ``TREE_BITS``, so that large groups of texts that are alike, but not enough, send no pairs.

A cell first tests its smallest document against all others, which settles large groups of near
copies with one test a document. Only cells that still hold several components are searched by
R-tree, for pairs of different components; large ones are cut into blocks that meet in pairs, so
no task holds more than two blocks. Every link that could change a component is tested.

Defined results: null or wordless texts have empty sets and link with nothing; with fewer words
than a shingle the whole sequence is the one shingle. Rows that share an id are one node; rows
with a null id stand alone and their component is null. Sets are compared by 64-bit hashes of
shingles, classes by 128 bits. Further columns are ignored, or kept by ``keep_one``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from flowlens.llm.components import components, star_edges
from flowlens.llm.sketch import repeated_keys
from flowlens.llm.wordscan import Splitter, mix, slices
from flowlens.session import materialize

DIMENSIONS = 64
BAND_RATIO = 1.5
BLOCK_POINTS = 1_024
LEAF, FANOUT = 32, 16
BLOCK_SHINGLES = 100_000
PARITY_BITS = 1 << 16
# Bits of a parity vector that go to the tree's tasks, and 64-bit words of pairs that are compared at a time.
TREE_BITS = 1 << 12
PAIR_WORDS = 1 << 20


def shingle_sets(words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) pairs in the order of rows and hashes."""
    starts = words.starts(k)
    row, hashes = words.row[starts], words.grams(k)[starts]
    short = np.flatnonzero((words.count() > 0) & (words.count() < k))
    if len(short):
        whole = []
        for r in short:
            total = np.full(1, words.first[r + 1] - words.first[r], np.uint64)
            for i in range(words.first[r], words.first[r + 1]):
                total = total * np.uint64(0xD1342543DE82EF95) + words.hash[i]
            whole.append(mix(total)[0])
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def add_up(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size, np.uint64)
    np.add.at(total, at, values)
    return total


class Bands:
    """Size bands of sets and the number of groups that finds every linked pair of a band."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] * BAND_RATIO))))
        self.low = np.array(self.low)
        smaller = self.low[1:] - 1
        larger = smaller * 100 // percent
        self.differ = (smaller + larger) * (100 - percent) // (100 + percent)
        self.spare = 1 + self.differ // 16
        self.groups = np.where(self.differ > 0, self.differ + 1 + self.spare, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def cells(self, row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: in its own band, and in those of the smaller sets it may link with."""
        n = np.bincount(row, minlength=rows)
        own, lowest = self.of(np.maximum(n, 1)), self.of(np.maximum(-(-n * self.percent // 100), 1))
        found = []
        for below in range(int((own - lowest).max(initial=0)) + 1):
            band = own - below
            groups = np.where((band >= lowest) & (n > 0), self.groups[np.maximum(band, 0)], 0)
            base = np.cumsum(groups) - groups
            part = groups[row] > 0
            r, h = row[part], hashes[part]
            spread = mix(h ^ np.uint64(0x5851F42D4C957F2D))
            group = (((spread >> np.uint64(32)) * groups[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total = int(groups.sum())
            content = add_up(base[r] + group, mix(h), total)
            count = np.bincount(base[r] + group, minlength=total)
            at_row = np.repeat(np.arange(rows), groups)
            number = np.arange(total) - base[at_row]
            empty = np.bincount(at_row, weights=count == 0, minlength=rows)
            emit = (count > 0) | (empty > self.spare[np.maximum(band, 0)])[at_row]
            place = (band[at_row].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
            found.append((at_row[emit], mix(content + mix(place))[emit]))
        r, cell = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(r, kind="stable")
        return r[order], cell[order]


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima: no two sets with these group counts share more shingles."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def may_link(bound, n, m, percent: int):
    """Whether ``bound`` shared shingles would be enough: 100 |A and B| >= percent |A or B|."""
    return (100 + percent) * bound >= percent * (n + m)


def parities(row: np.ndarray, hashes: np.ndarray, rows: int) -> list[bytes]:
    """Counts modulo two of each row's shingles in one to two groups a shingle (powers of two, 64 at least), as bits."""
    n = np.bincount(row, minlength=rows)
    bits = np.left_shift(1, np.ceil(np.log2(np.clip(n, 64, PARITY_BITS))).astype(np.int64))
    base = np.cumsum(bits) - bits
    group = (mix(hashes ^ np.uint64(0x94D049BB133111EB)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[row] + group, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[b // 8 : (b + w) // 8].tobytes() for b, w in zip(base.tolist(), bits.tolist())]


def difference_bound(a: bytes, b: bytes) -> int:
    """Groups in which the sets' parities differ: no more than the shingles that only one of the sets has."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def folded(parity: bytes, bits: int) -> bytes:
    """The vector in at most ``bits`` groups (a power of two)."""
    words = np.frombuffer(parity, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, min(len(words), bits // 64)), axis=0).tobytes()


def difference_bounds(vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`difference_bound` of the pairs (i, j) of ``vectors``, those of equal lengths together."""
    if len(i) < 16:
        return np.array([difference_bound(vectors[a], vectors[b]) for a, b in zip(i, j)], np.int64)
    words = np.array([len(v) // 8 for v in vectors])
    tables, place = {}, np.zeros(len(words), np.int64)
    for w in np.unique(words).tolist():
        of = np.flatnonzero(words == w)
        place[of] = np.arange(len(of))
        tables[w] = np.frombuffer(b"".join(vectors[x] for x in of), np.uint64).reshape(-1, w)
    swap = words[i] > words[j]
    short, long = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros(len(i), np.int64)
    for w, x in tables.items():
        for v, y in tables.items():
            of = np.flatnonzero((words[short] == w) & (words[long] == v))
            if not len(of):
                continue
            y = np.bitwise_xor.reduce(y.reshape(len(y), -1, w), axis=1)
            for some in np.split(of, range(PAIR_WORDS // w, len(of), PAIR_WORDS // w)):
                apart = x[place[short[some]]] ^ y[place[long[some]]]
                out[some] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
    return out


class CountTree:
    """R-tree over group counts, packed by sorting along the size and the widest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.points, self.sizes, self.labels = points, sizes, labels
        wide = np.argsort(-points.var(axis=0), kind="stable")[:2]
        tile = max(1, int(np.ceil(np.sqrt(len(points) / LEAF)))) * LEAF
        order = np.argsort(sizes, kind="stable")
        order = np.concatenate([o[np.lexsort((points[o, wide[-1]], points[o, wide[0]]))] for o in np.split(order, range(tile, len(order), tile))])
        self.order, self.levels = order, []
        highest, low, high = points[order], sizes[order], sizes[order]
        one, other = labels[order], labels[order]
        step = LEAF
        while True:
            cut = np.arange(0, len(highest), step)
            highest = np.maximum.reduceat(highest, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            one, other = np.minimum.reduceat(one, cut), np.maximum.reduceat(other, cut)
            self.levels.append((step, highest, low, high, one, other))
            if len(cut) == 1:
                break
            step = FANOUT

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of points of different labels that the bound lets link."""
        n = len(self.points)
        if n <= LEAF:
            bound = overlap_bound(self.points[:, None], self.points[None])
            fits = may_link(bound, self.sizes[:, None], self.sizes[None], percent) & (self.labels[:, None] != self.labels[None])
            return np.nonzero(np.triu(fits, 1))
        kinds, at, count = np.unique(self.labels, return_inverse=True, return_counts=True)
        most = at == count.argmax()  # one side of a pair of different labels is not of the commonest
        firsts, seconds = [], []
        for i in np.flatnonzero(~most):
            j = self.search(self.points[i], self.sizes[i], self.labels[i], percent)
            j = j[most[j] | (j > i)]
            firsts.append(np.full(len(j), i))
            seconds.append(j)
        return np.concatenate([np.zeros(0, np.int64), *firsts]), np.concatenate([np.zeros(0, np.int64), *seconds])

    def search(self, point: np.ndarray, size: int, label: int, percent: int) -> np.ndarray:
        """Points of other labels whose bound lets them link with ``point``."""
        nodes = np.array([0])
        for level in range(len(self.levels) - 1, -1, -1):
            step, highest, low, high, one, other = self.levels[level]
            bound = overlap_bound(point, highest[nodes])
            fits = may_link(bound, size, low[nodes], percent) & (high[nodes] * 100 >= percent * size) & (low[nodes] * percent <= 100 * size)
            nodes = nodes[fits & ((one[nodes] != label) | (other[nodes] != label))]
            below = len(self.order) if level == 0 else len(self.levels[level - 1][1])
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        at = self.order[nodes]
        at = at[self.labels[at] != label]
        return at[may_link(overlap_bound(point, self.points[at]), size, self.sizes[at], percent)]


SUMMARY = "doc long, n long, one long, two long, point binary, parity binary, folded binary"


def _summaries(k: int):
    def run(batches):
        splitter = Splitter("plain", lower=True)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                row, hashes = shingle_sets(splitter.words(part.column("text")), rows, k)
                one, two = add_up(row, mix(hashes), rows), add_up(row, mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), rows)
                group = (mix(hashes ^ np.uint64(0x27D4EB2F165667C5)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
                counts = np.bincount(row * DIMENSIONS + group, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
                points = [p.tobytes() for p in np.minimum(counts, (1 << 32) - 1).astype(np.uint32)]
                whole = parities(row, hashes, rows)
                few = [folded(p, TREE_BITS) for p in whole]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(np.bincount(row, minlength=rows)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(points, pa.binary()), pa.array(whole, pa.binary()), pa.array(few, pa.binary())],
                    ["doc", "n", "one", "two", "point", "parity", "folded"],
                )

    return run


def _cells(k: int, percent: int):
    def maker():
        splitter, bands = Splitter("plain", lower=True), Bands(percent)

        def extract(texts):
            return bands.cells(*shingle_sets(splitter.words(texts), len(texts), k), len(texts))

        return extract

    return maker


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, DIMENSIONS) for c in ("p", "q"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            fits = may_link(overlap_bound(a, b), n, m, percent)
            left, right = batch.column("s"), batch.column("t")
            for i in np.flatnonzero(fits):
                differ = difference_bound(left[i].as_py(), right[i].as_py())
                fits[i] = may_link((n[i] + m[i] - differ) // 2, n[i], m[i], percent)
            yield batch.filter(pa.array(fits)).select(["a", "b"])

    return run


def _tree_pairs(percent: int):
    """Streams cells that follow one another; one cell, or one pair of its blocks, is in memory at a time."""

    def pairs(held):
        points, sizes, labels, doc, block, vectors = (np.concatenate(x) for x in zip(*held))
        i, j = CountTree(points, sizes, labels).pairs(percent)
        if len(np.unique(block)) > 1:  # pairs within one of two blocks are found in that block's own group
            apart = block[i] != block[j]
            i, j = i[apart], j[apart]
        n, m = sizes[i], sizes[j]
        fits = may_link((n + m - difference_bounds(vectors, i, j)) // 2, n, m, percent)
        i, j = i[fits], j[fits]
        return np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])

    def run(batches):
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "low", "high")])
            points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.uint32).reshape(-1, DIMENSIONS)
            columns = [points, *(batch.column(c).to_numpy() for c in ("n", "component", "doc", "block"))]
            columns.append(np.array(batch.column("folded").to_pylist(), object))
            edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            found = []
            for x, y in zip(edges, [*edges[1:], batch.num_rows]):
                here = tuple(key[:, x])
                if here != at and held:
                    found.append(pairs(held))
                    held = []
                at = here
                held.append([v[x:y] for v in columns])
            if found:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate([f for f, _ in found]), "b": np.concatenate([g for _, g in found])})
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip("ab", pairs(held))))

    return run


def _verified(k: int, percent: int):
    def run(batches):
        splitter, key, sets, forest = Splitter("plain", lower=True), None, {}, {}

        def find(x):
            while forest.setdefault(x, x) != x:
                forest[x] = forest[forest[x]]
                x = forest[x]
            return x

        for batch in batches:
            for part in slices(batch, "text"):
                row, hashes = shingle_sets(splitter.words(part.column("text")), part.num_rows, k)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                links = []
                columns = (part.column(c).to_pylist() for c in ("cluster", "low", "high", "a", "b"))
                for r, (*at, a, b) in enumerate(zip(*columns)):
                    if at != key:
                        key, sets, forest = at, {}, {}
                    if b is None:  # a set; several rows of one id are several
                        sets.setdefault(a, []).append(hashes[edges[r] : edges[r + 1]].copy())
                    elif find(a) != find(b) and any(_same(x, y, percent) for x in sets[a] for y in sets[b]):
                        forest[find(a)] = find(b)
                        links.append((a, b))
                if links:
                    yield pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [y for _, y in links]})

    return run


def _same(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return may_link(int((a[at] == b).sum()), len(a), len(b), percent)


def verify(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs whose whole sets are similar enough; pairs that others connect may be left out.

    Pairs are gathered by connected clusters, so a text is sent once to all its pairs. Clusters of many
    shingles (by ``sizes``: doc, n) are cut into blocks that meet in pairs; a task holds the sets of two.
    """
    cluster = components(pairs)
    weight = cluster.join(sizes, F.col("node") == F.col("doc")).groupBy("component").agg(F.sum("n").alias("n"))
    blocks = weight.select("component", F.ceil(F.col("n") / BLOCK_SHINGLES).alias("blocks"))
    placed = cluster.join(blocks, "component").select(
        "node", F.col("component").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    )
    a = placed.select(F.col("node").alias("a"), "cluster", F.col("block").alias("p"))
    b = placed.select(F.col("node").alias("b"), F.col("block").alias("q"))
    asked = pairs.join(a, "a").join(b, "b")
    asked = asked.select("cluster", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), "a", "b")
    asked = materialize(asked, "asked")
    at = ["cluster", "low", "high"]
    needed = asked.select(*at, "a").union(asked.select(*at, "b")).distinct()
    heads = needed.join(texts.withColumnRenamed("doc", "a"), "a").select(*at, "a", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(asked.withColumn("text", F.lit(None).cast("string")))
    parts = rows.repartition(*at).sortWithinPartitions(*at, F.col("b").asc_nulls_first())
    return parts.mapInArrow(_verified(k, percent), "a long, b long")


def link_documents(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n, component) of every row: size of its set, smallest id it reaches by links of ``percent`` or more."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), "text")
    known = materialize(texts.mapInArrow(_summaries(k), SUMMARY), "sets")
    sets = known.where("doc is not null and n > 0")
    heads = sets.groupBy("n", "one", "two").agg(F.min("doc").alias("head"))
    classes = sets.join(heads, ["n", "one", "two"])
    points = materialize(classes.where("doc = head").select("doc", "n", "one", "two", "point", "parity", "folded").dropDuplicates(["doc", "one", "two"]), "points")

    rows = texts.where("doc is not null").withColumnRenamed("doc", "rid")
    cells = repeated_keys(rows, _cells(k, percent), 0.04 * (100 - percent) / 10, by_row=True)
    cells = cells.join(points.select(F.col("doc").alias("rid")).distinct(), "rid", "left_semi")
    cells = materialize(cells.select(F.col("rid").alias("doc"), F.explode(F.array_distinct("keys")).alias("cell")), "cells")
    shared = cells.groupBy("cell").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("doc").alias("members"))
    shared = materialize(shared.where("first < last"), "shared")
    firsts = cells.join(shared, "cell").where("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    firsts = materialize(bounded_pairs(firsts, points, percent), "firsts")

    texts = texts.where("doc is not null")
    same_id = classes.where("doc != head").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    sizes = points.groupBy("doc").agg(F.sum("n").alias("n"))
    links = materialize(verify(firsts, sizes, texts, k, percent), "links")
    linked = materialize(components(links), "linked")

    placed = points.join(linked, F.col("doc") == F.col("node"), "left").select("doc", "n", "one", "two", "point", "folded", F.coalesce("component", "doc").alias("component"))
    rest = cells.join(shared.where("members > 2").select("cell"), "cell", "left_semi").join(placed, "doc")
    mixed = rest.groupBy("cell").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("doc").alias("members"),
        F.expr("bit_xor(xxhash64(doc, one, two))").alias("one"), F.expr("bit_xor(xxhash64(two, one, doc, 1))").alias("two"),
    )  # fmt: skip; no row of a cell comes twice, so that none cancels another
    mixed = mixed.where("low < high").groupBy("members", "one", "two").agg(F.min("cell").alias("cell"))  # of equal cells, one
    rest = rest.drop("one", "two").join(mixed.select("cell", "members"), "cell")
    pairs = tree_pairs(rest, percent).join(firsts, ["a", "b"], "left_anti")
    pairs = materialize(bounded_pairs(pairs, points, percent), "pairs")
    links = links.union(materialize(verify(pairs, sizes, texts, k, percent), "links")).union(same_id)
    reached = components(links)
    out = known.join(reached, F.col("doc") == F.col("node"), "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def bounded_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs that neither the sum of coordinate minima nor the parities rule out."""
    a = points.select(F.col("doc").alias("a"), "n", F.col("point").alias("p"), F.col("parity").alias("s"))
    b = points.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("point").alias("q"), F.col("parity").alias("t"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "p", "q", "s", "t")
    return both.mapInArrow(_bounded(percent), "a long, b long")


def tree_pairs(points: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a cell that neither the R-tree's bound nor folded parities rule out; large cells in pairs of blocks."""
    blocks = F.ceil(F.col("members") / BLOCK_POINTS)
    own = F.pmod(F.xxhash64("doc", "n", "point"), blocks)
    split = points.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    split = split.select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc", "n", "point", "folded", "component", "block",
    )
    at = ["cell", "low", "high"]
    found = split.repartition(*at).sortWithinPartitions(*at).mapInArrow(_tree_pairs(percent), "a long, b long")
    return found.distinct()


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, and all documents without links.

    Repeated rows of one id count as copies, and the one whose text has the smallest hash stays; rows without
    an id stay.
    """
    groups = link_documents(documents.select("doc_id", "text"), k, percent).where("doc = component or n = 0").select("doc").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole")  # so that no column's name clashes
    known = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), whole)
    place = F.row_number().over(W.partitionBy("doc").orderBy(F.xxhash64("whole.text"), "whole.text"))
    kept = known.join(groups, "doc", "left_semi").withColumn("place", place).where("place = 1").select("whole.*")
    return kept.unionByName(documents.where("doc_id is null"))
