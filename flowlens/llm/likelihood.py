"""Log probabilities of texts: add-one word counts, and a subword lattice over all segmentations.

The lattice model draws pieces of an existing vocabulary independently until an end. A text's
probability is the sum over all of its segmentations into pieces, by a forward recursion in
log space. The vocabulary's own scores weight the segmentations first (log probabilities as they are; in a
vocabulary of the merge kind scores are falling ranks, which stand for weights 1 / (1 + rank)). Under
those weights every piece's expected count over all segmentations of the training texts is
taken, forward and backward, and the counts with the first weights as a prior are the model;
``rounds`` repeats that. Characters without a piece are spelled as byte pieces, so every text has a
probability. No piece spans the border before a space mark that follows another character, so the lattice
falls into chunks whose log probabilities add up; equal chunks of a slice (by a hash of 64 bits) are worked once.

Counts cover all training texts: words and chunks are counted in tasks, added up by Spark and kept
as tables. Only words that make up at least one in ``FREQUENT`` of all words go to the tasks (so
at most that many); every other word of a document is joined to the counts by its hash of 128 bits,
and such a word is never a hot key. The driver gets those words and one number for each piece.

Null texts are empty: one token, the end. A null id is trained on. Without training texts all counts
are zero and the first weights stay. Repeated rows and ids each give their row, and count as often; other columns are
ignored. Memory follows the longest text.
"""

import math
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import BATCH_CHARS, Model, cut
from flowlens.llm.wordscan import BASES, Hasher, Powers, Splitter, mix, slices
from flowlens.session import materialize

FREQUENT = 200_000
FOLDS, HELD_OUT = 7, 2
PRIOR = 32_000.0
CHUNK_WORDS = 1 << 20
SLICE_BYTES = 1 << 21
CACHE_BITS = 20
FREQUENT_BITS = 21
FREQUENT_SHIFT = np.uint64(64 - FREQUENT_BITS)
BATCH_PLACES = 1 << 16
COUNTS = "h1 long, h2 long, c long, total long"
POWERS = Powers(BASES[0])
SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double,"
    " rare array<struct<h1:long,h2:long,tf:long>>"
)


def split_rows(documents: DataFrame) -> DataFrame:
    """Ids, texts and whether a row is held out."""
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return documents.select(doc_id.alias("doc_id"), "text", held_out.alias("held_out"))


class WordHashes:
    """Words of a slice with hashes of 128 bits."""

    def __init__(self):
        self.splitter, self.second = Splitter("plain", lower=True), Hasher(1)

    def __call__(self, texts: pa.Array):
        words = self.splitter.words(texts)
        return words, words.hash, self.second.ranges(self.second.sums(words.data), words.start, words.end)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal entries of sorted columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _count_words(batches):
    hashes, kept, size = WordHashes(), [], 0

    def flush():
        h1, h2, c = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(h1)
        h1, h2, c = h1[order], h2[order], c[order]
        at = _runs(h1, h2)
        columns = [h1[at].view(np.int64), h2[at].view(np.int64), np.add.reduceat(c, at), np.diff(np.append(at, len(h1)))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h1", "h2", "c", "total"])

    for batch in batches:
        for part in slices(batch, "text"):
            words, h1, h2 = hashes(part.column("text"))
            trained = ~part.column("held_out").to_numpy(zero_copy_only=False)[words.row]
            kept.append((h1, h2, trained.astype(np.int64)))
            size += len(h1)
            if size >= CHUNK_WORDS:
                yield flush()
                kept, size = [], 0
    if size:
        yield flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """Per word (as a hash) its occurrences in training texts and in all texts."""
    counted = rows.select("text", "held_out").mapInArrow(_count_words, COUNTS)
    return counted.groupBy("h1", "h2").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


class Chunks:
    """The lattice chunks of texts and their hashes of 64 bits; ``first[r]`` is the first chunk of text r."""

    def __init__(self, model: Model, texts: pa.Array):
        normal = model.processor.normalize(pc.fill_null(texts, "").to_pylist()) if len(texts) else []
        self.text = "".join(normal)
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        rows = np.append(0, np.cumsum([len(x) for x in normal]))
        self.start = cut(chars, rows[:-1][np.diff(rows) > 0])
        self.end = np.append(self.start[1:], len(chars))[: len(self.start)]
        self.first = np.searchsorted(self.start, rows)
        up, down = POWERS.upto(len(chars))
        sums = np.append(np.uint64(0), np.cumsum(mix(chars.astype(np.uint64)) * up[: len(chars)], dtype=np.uint64))
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + size)

    def names(self, which: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct hash, how often it comes, and the number of the hash at every place."""
    order = np.argsort(hashes)
    at = _runs(hashes[order])
    count = np.diff(np.append(at, len(hashes)))
    which = np.empty(len(hashes), np.int64)
    which[order] = np.repeat(np.arange(len(at)), count)
    return order[at], count, which


def worker_model(path: str) -> Model:
    """The Python worker's copy of the vocabulary, kept from task to task."""
    kept = sys.modules.setdefault("_lattice_models", types.ModuleType("_lattice_models"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Model(path)
        if kept.__dict__[path].spanning:
            raise ValueError("pieces of this vocabulary span words")
    return kept.__dict__[path]


def _count_chunks(path: str):
    def run(batches):
        model = worker_model(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                chunks = Chunks(model, part.column("text"))
                at, count, _ = distinct(chunks.hash)
                yield pa.RecordBatch.from_arrays([pa.array(chunks.names(at), pa.string()), pa.array(count, pa.int64())], ["chunk", "n"])

    return run


def chunk_counts(rows: DataFrame, path: str) -> DataFrame:
    """Per distinct chunk of the training texts its number of occurrences."""
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_count_chunks(path), "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def first_weights(model: Model) -> np.ndarray:
    """Probabilities of all pieces, and of the end after them, as the vocabulary's scores give them."""
    own = np.array(sorted(model.pieces.values()), np.int64)
    scores = model.scores[own]
    ranked = bool((scores == np.floor(scores)).all())
    weights = np.zeros(len(model.scores) + 1)
    weights[own] = 1 / (1 - scores) if ranked else np.exp(scores)
    weights[model.bytes] = weights[own].min()
    weights[-1] = weights.sum() / (len(own) + 1)
    return weights / weights.sum()


class Lattice:
    """All segmentations of chunks, weighted by the pieces' probabilities."""

    def __init__(self, model: Model, weights: np.ndarray):
        self.model, self.spelled = model, {}
        with np.errstate(divide="ignore"):
            self.logs = np.log(weights)
        self.steps = np.append(self.logs[:-1], -np.inf)  # the last for no piece

    def _spelled(self, char: str) -> float:
        if char not in self.spelled:
            self.spelled[char] = float(self.logs[self.model.spell(char)].sum())
        return self.spelled[char]

    def _pieces(self, chunks: list[str], n: int):
        """For each end, the first start and the pieces from every start on (-1: none)."""
        model = self.model
        if n <= BATCH_CHARS:
            chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(len(chunks), n)
            sums = np.concatenate([np.zeros((len(chunks), 1), np.uint64), model.hashes(chars.astype(np.uint64))], axis=1)
        for e in range(1, n + 1):
            low = max(0, e - model.longest)
            if n <= BATCH_CHARS:
                spans = (sums[:, e : e + 1] - sums[:, low:e]) * model.down[low:e]
                yield low, model.lookup(spans.ravel()).reshape(len(chunks), e - low)
            else:
                yield low, np.array([[model.pieces.get(c[s:e], -1) for s in range(low, e)] for c in chunks])

    def forward(self, chunks: list[str], n: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """Log probabilities of all beginnings of chunks of ``n`` characters; with ``keep``, per end the pieces
        that reach it and their shares of its probability."""
        alpha = np.zeros((len(chunks), n + 1))
        edges = []
        for e, (low, ids) in enumerate(self._pieces(chunks, n), 1):
            through = self.steps[ids]
            for r in np.flatnonzero(ids[:, -1] < 0):
                through[r, -1] = self._spelled(chunks[r][e - 1])
            through += alpha[:, low:e]
            best = through.max(axis=1, keepdims=True)
            np.exp(np.subtract(through, best, out=through), out=through)
            total = through.sum(axis=1, keepdims=True)
            alpha[:, e] = (best + np.log(total))[:, 0]
            if keep:
                edges.append((low, ids, through / total))
        return alpha, edges

    def expect(self, chunks: list[str], n: int, counts: np.ndarray, into: np.ndarray) -> None:
        """Adds every piece's expected count over all segmentations, ``counts`` times each chunk.

        ``passing`` is how often a segmentation passes a border between characters, from the end backward.
        """
        _, edges = self.forward(chunks, n, keep=True)
        passing = np.zeros((len(chunks), n + 1))
        passing[:, n] = counts
        for e in range(n, 0, -1):
            low, ids, share = edges[e - 1]
            share *= passing[:, e : e + 1]
            known = np.flatnonzero(ids >= 0)
            into += np.bincount(ids.ravel()[known], share.ravel()[known], minlength=len(into))
            for r in np.flatnonzero(ids[:, -1] < 0):
                np.add.at(into, self.model.spell(chunks[r][e - 1]), share[r, -1])
            passing[:, low:e] += share


def by_length(chunks: list[str]):
    """Places of chunks of equal length, a bounded number at a time, with that length."""
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    order = np.argsort(size, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        n = int(size[own[0]]) if len(own) else 0
        step = max(1, BATCH_PLACES // n) if n <= BATCH_CHARS else 1
        for first in range(0, len(own), step):
            yield own[first : first + step], n


def _expect(path: str, weights: np.ndarray):
    def run(batches):
        lattice, total = Lattice(worker_model(path), weights), np.zeros(len(weights))
        for batch in batches:
            for part in slices(batch, "chunk", SLICE_BYTES):
                chunks, counts = part.column("chunk").to_pylist(), part.column("n").to_numpy().astype(np.float64)
                for own, n in by_length(chunks):
                    lattice.expect([chunks[k] for k in own], n, counts[own], total)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["piece", "expected"])

    return run


def fit_weights(chunks: DataFrame, ends: int, path: str, rounds: int = 1) -> np.ndarray:
    """Probabilities of pieces and of the end, from expected counts over the training texts' segmentations."""
    prior = weights = first_weights(Model(path))
    for _ in range(rounds):
        summed = chunks.mapInArrow(_expect(path, weights), "piece int, expected double").groupBy("piece")
        counts = np.zeros(len(prior))
        for r in summed.agg(F.sum("expected").alias("expected")).collect():
            counts[r.piece] = r.expected
        counts[-1] = ends
        weights = (counts + PRIOR * prior) / (counts.sum() + PRIOR)
    return weights


class Slots:
    """Values of 64-bit keys, one key a slot: a newer key takes its slot over, so memory is fixed."""

    def __init__(self, bits: int = CACHE_BITS):
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, not a number where they are not known."""
        slot = (keys >> self.shift).view(np.int64)
        return np.where(self.keys[slot] == keys, self.values[slot], np.nan)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys >> self.shift).view(np.int64)
        self.keys[slot], self.values[slot] = keys, values


class Scorer:
    """Log probabilities of texts, with a bounded cache of chunks."""

    def __init__(self, model: Model, weights: np.ndarray):
        self.lattice, self.cache = Lattice(model, weights), Slots()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        chunks = Chunks(self.lattice.model, texts)
        logs = self.cache.get(chunks.hash)
        unknown = np.flatnonzero(np.isnan(logs))
        at, _, which = distinct(chunks.hash[unknown])
        names, found = chunks.names(unknown[at]), np.zeros(len(at))
        for own, n in by_length(names):
            found[own] = self.lattice.forward([names[k] for k in own], n)[0][:, n]
        logs[unknown] = found[which]
        self.cache.put(chunks.hash[unknown[at]], found)
        row = np.repeat(np.arange(len(texts)), np.diff(chunks.first))
        return np.bincount(row, logs, minlength=len(texts)) + self.lattice.logs[-1]


class FrequentWords:
    """Counts of the words that tasks know; ``count`` is -1 for others."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, c: np.ndarray):
        order = np.argsort(h1)
        self.h1, self.h2, self.c, self.slots = h1[order], h2[order], c[order], None

    def _index(self) -> None:
        """Where the words of each slot (leading bits) begin; made in the task, not sent to it."""
        slots = (self.h1 >> FREQUENT_SHIFT).view(np.int64)
        at = _runs(slots)
        self.run = int(np.diff(np.append(at, len(slots))).max())
        self.slots = np.full(1 << FREQUENT_BITS, -1, np.int32)
        self.slots[slots[at]] = at
        self.h1, self.h2, self.c = (np.append(x, np.zeros(self.run, x.dtype)) for x in (self.h1, self.h2, self.c))

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.full(len(h1), -1)
        if not len(self.h1):
            return found
        if self.slots is None:
            self.size = len(self.h1)
            self._index()
        first = self.slots[(h1 >> FREQUENT_SHIFT).view(np.int64)]
        open_ = np.flatnonzero(first >= 0)
        for k in range(self.run):
            at = first[open_] + k
            same = (self.h1[at] == h1[open_]) & (self.h2[at] == h2[open_]) & (at < self.size)
            found[open_[same]] = self.c[at[same]]
            open_ = open_[~same]
        return found


def frequent_words(words: DataFrame, everything: int) -> FrequentWords:
    found = words.where(F.col("total") * FREQUENT >= everything).toArrow()
    columns = [found.column(c).to_numpy() for c in ("h1", "h2", "c")]
    return FrequentWords(columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2])


def _rare(row: np.ndarray, h1: np.ndarray, h2: np.ndarray, rows: int) -> pa.Array:
    """For each row its distinct words and how often it holds them."""
    order = np.lexsort((h2, h1, row))
    row, h1, h2 = row[order], h1[order], h2[order]
    at = _runs(row, h1, h2) if len(row) else np.zeros(0, np.int64)
    columns = [h1[at].view(np.int64), h2[at].view(np.int64), np.diff(np.append(at, len(row)))]
    entries = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "tf"])
    offsets = np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _score(path: str, weights: np.ndarray, frequent: FrequentWords):
    def run(batches):
        scorer, hashes = Scorer(worker_model(path), weights), WordHashes()
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = part.num_rows
                words, h1, h2 = hashes(part.column("text"))
                c = frequent.count(h1, h2)
                rare = c < 0
                logs = np.bincount(words.row, np.where(rare, 0.0, np.log10(np.maximum(c, 0) + 1)), minlength=rows)
                known = np.bincount(words.row[c > 0], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place + np.arange(rows), pa.int64()), part.column("doc_id"), part.column("held_out"),
                     pa.array(words.count() + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(logs),
                     pa.array(scorer(part.column("text")) / math.log(10)),
                     _rare(words.row[rare], h1[rare], h2[rare], rows)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare"],
                )
                place += rows

    return run


def score_texts(documents: DataFrame, vocabulary: str, rounds: int = 1) -> DataFrame:
    """Per document: whether it was held out, tokens, tokens seen in training, training tokens, and the log10
    probabilities of the add-one word counts (``base_score``) and of the subword lattice (``score``)."""
    rows = split_rows(documents)
    words = materialize(word_counts(rows), "word_counts")
    seen = words.agg(F.sum("c").alias("c"), F.sum("total").alias("total"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    ends = rows.where(~F.col("held_out")).count()
    train_tokens, distinct = int(seen.c or 0) + ends, int(seen.distinct) + (ends > 0)

    chunks = chunk_counts(rows, vocabulary)
    weights = fit_weights(chunks if rounds < 2 else materialize(chunks, "chunk_counts"), ends, vocabulary, rounds)
    frequent = frequent_words(words, int(seen.total or 0))
    scored = materialize(rows.mapInArrow(_score(vocabulary, weights, frequent), SCORED), "scored_texts")

    found = scored.select("row", F.inline("rare")).join(words.select("h1", "h2", "c"), ["h1", "h2"])
    rest = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"),
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + math.log10(ends + 1)
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)).alias("base_score"),
        "score",
    )
