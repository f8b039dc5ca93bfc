"""Benchmark decontamination by Wu-Manber search over word sequences.

A benchmark item of at least ``window`` words gives all its windows of that many consecutive
words as patterns, a shorter one is a single pattern. Patterns of one length share a table
that says how far a scan may jump after reading a block of two words, buckets of patterns by
the hash of their last block, and a direct comparison of the words. A slice of documents is
scanned in many lanes at once, each jumping by its own shifts.

Benchmarks of any size: Spark cuts items into pieces of a bounded number of windows, which overlap so that every
window lies in one piece, and deals them into blocks of a bounded number of windows. Documents pass
through one scan per block, without a shuffle. The driver and the tasks hold one block at a time: where there are
several, what was found so far is written out after each.

Nulls: a null text has no words; benchmark rows without id or words are no items. Repeated
items count once, repeated documents each give their row. Only the named columns are read,
so further columns, whatever their names, are no matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.wordscan import Splitter, runs, slices
from flowlens.session import materialize

LANE_WORDS = 1024
BLOCK_WINDOWS = 200_000
PIECE_WINDOWS = 4_096
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STATE = T.StructType().add("text", "string").add("words", "long")
for _name in ("starts", "ends", "items"):
    STATE.add(_name, T.ArrayType(T.LongType()))


class Patterns:
    """Shift table and suffix buckets of patterns of one length, as rows of word hashes."""

    def __init__(self, words: np.ndarray, texts: list[tuple], items: list[np.ndarray]):
        self.length, self.block = words.shape[1], min(2, words.shape[1])
        self.bits = max(12, int(np.ceil(np.log2(16 * words.size + 1))))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int64)
        for j in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._cell(self._suffix(words, j)), self.length - 1 - j)
        suffix = self._suffix(words, self.length - 1)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.words = suffix[order], words[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]

    def _suffix(self, words, j):
        return words[:, j] if self.block == 1 else words[:, j - 1] * np.uint64(0x9E3779B97F4A7C15) + words[:, j]

    def _cell(self, suffix):
        return (suffix * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - self.bits)

    def search(self, found) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of each occurrence in a slice's words."""
        h, m = found.hash, self.length
        at = np.arange(0, len(h), LANE_WORDS)
        stop = np.minimum(at + LANE_WORDS, len(h))
        at = np.maximum(at, m - 1)
        ends = []
        while len(at):
            keep = at < stop
            at, stop = at[keep], stop[keep]
            block = h[at] if self.block == 1 else h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at]
            shift = self.shift[self._cell(block)]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
        ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        ends = ends[found.row[ends] == found.row[ends - m + 1]]
        block = h[ends] if self.block == 1 else h[ends - 1] * np.uint64(0x9E3779B97F4A7C15) + h[ends]
        low, high = np.searchsorted(self.suffix, block), np.searchsorted(self.suffix, block, side="right")
        count = high - low
        ends = np.repeat(ends, count)
        number = np.arange(len(ends)) + np.repeat(low - (np.cumsum(count) - count), count)
        for j in range(m):
            same = self.words[number, j] == h[ends - m + 1 + j]
            ends, number = ends[same], number[same]
        starts = ends - m + 1
        same = [self.texts[p] == tuple(found.text(i + j) for j in range(m)) for i, p in zip(starts, number)]
        same = np.array(same, bool)
        return starts[same], number[same]


def compile_patterns(items, window: int) -> list[Patterns]:
    """Pattern tables of (item_id, text) pairs, one for each pattern length."""
    splitter, found = Splitter("letters", lower=True), {}
    for item, text in items:
        words = splitter.words(pa.array([text], pa.string()))
        n, texts = len(words.hash), [words.text(i) for i in range(len(words.hash))]
        m = min(window, n)
        for i in range(n - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(tuple(texts[i : i + m]), (words.hash[i : i + m], set()))[1].add(item)
    return [
        Patterns(np.array([h for h, _ in group.values()]), list(group), [np.array(sorted(ids)) for _, ids in group.values()])
        for group in found.values()
    ]


def _scan(tables: list[Patterns]):
    def run(batches):
        splitter = Splitter("letters", lower=True)
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.words(part.column("text"))
                starts, ends, items = ([list(x or ()) for x in part.column(c).to_pylist()] for c in ("starts", "ends", "items"))
                for table in tables:
                    at, number = table.search(words)
                    for i, p in zip(at, number):
                        r = words.row[i]
                        starts[r].append(int(i - words.first[r]))
                        ends[r].append(int(i - words.first[r]) + table.length)
                        items[r].extend(table.items[p].tolist())
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("text"), pa.array(words.count(), pa.int64()), pa.array(starts, longs),
                     pa.array(ends, longs), pa.array([sorted(set(x)) for x in items], longs), part.column("row")],
                    ["text", "words", "starts", "ends", "items", "row"],
                )

    return run


def benchmark_pieces(benchmark: DataFrame, window: int, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """(item_id, text): each item's words in pieces of at most ``piece_windows`` windows; no item without words."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select("item_id", F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)), F.lit(piece_windows))
    piece = F.transform(starts, lambda at: F.array_join(F.slice("words", at, piece_windows + window - 1), " "))
    return words.select("item_id", F.explode(piece).alias("text")).distinct()


def benchmark_blocks(benchmark: DataFrame, window: int, limit: int):
    """Number of blocks, and the blocks: lists of (item_id, text) of about ``limit`` windows, which one scan holds in memory."""
    pieces = materialize(benchmark_pieces(benchmark, window, min(PIECE_WINDOWS, limit)), "benchmark-pieces")
    total = pieces.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = -(-total // (2 * limit)) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r.item_id, r.text) for r in pieces.where(block == i).collect()] for i in range(n))


def find_occurrences(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``row`` (all columns but text), text, number of words, and word ranges and item ids of every occurrence."""
    none = F.array().cast("array<long>")
    state = documents.select(
        "text", F.lit(0).cast("long").alias("words"), none.alias("starts"), none.alias("ends"), none.alias("items"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row"),
    )
    schema = T.StructType([*STATE.fields, state.schema["row"]])
    n, blocks = benchmark_blocks(benchmark, window, block_windows)
    for items in blocks:
        state = state.mapInArrow(_scan(compile_patterns(items, window)), schema)
        if n > 1:
            state = materialize(state, "occurrences")
    return state


def _hit_words(batches):
    for batch in batches:
        words, starts, ends = (batch.column(c).to_pylist() for c in ("words", "starts", "ends"))
        hit = [
            int(runs(np.array(s), np.array(e) - np.array(s), n).sum()) if s else 0 for n, s, e in zip(words, starts, ends)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("words"), pa.array(hit, pa.int64()), batch.column("items")],
            ["doc_id", "n_words", "n_hit", "items"],
        )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: words, words inside occurrences, items that occur, and whether any does."""
    found = find_occurrences(documents.select("doc_id", "text"), benchmark, window)
    found = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "words", "starts", "ends", "items")
    counted = found.mapInArrow(_hit_words, "doc_id long, n_words long, n_hit long, items array<long>")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``documents`` without those that hold an occurrence; columns and the other rows unchanged."""
    found = find_occurrences(documents, benchmark, window).where(F.size("starts") == 0)
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
