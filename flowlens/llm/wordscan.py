"""Words and windows of many texts at once: numpy offsets into their UTF-8 bytes.

Texts come as Arrow columns. A column is cut into slices that fit a cache, so the memory
of a task follows the longest single text, never the batch. Null texts are empty.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _byte_mask(*ranges) -> np.ndarray:
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


def tables() -> dict[str, np.ndarray]:
    """Bytes that belong to a word: ``plain`` ends at ASCII white space, ``letters`` at any ASCII but a-z and 0-9."""
    return {
        "plain": ~_byte_mask((0x09, 0x0D), (0x20, 0x20)),
        "letters": _byte_mask((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)),
    }


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts of a batch whose texts take about ``limit`` bytes; at least one row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(sizes.astype(np.int64)), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one entry more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(n + 1, 1 << 16)
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


class Hasher:
    """64-bit hashes of byte ranges from one running sum; ``lane`` 0 and 1 are independent."""

    def __init__(self, lane: int = 0):
        self.powers = Powers(BASES[lane])
        self.codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (lane + 1)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.powers.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * up[: len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers.upto(len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice of rows, row after row; ``first[r]`` is the first word of row r."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``k`` words from each word on, whether or not they lie within one row."""
        h = self.hash if hashes is None else hashes
        n = max(len(h) - k + 1, 0)
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
        return mix(total)

    def starts(self, k: int) -> np.ndarray:
        """First words of the runs of ``k`` words that lie within one row."""
        n = max(len(self.hash) - k + 1, 0)
        return np.flatnonzero(self.row[:n] == self.row[k - 1 :]) if n else np.zeros(0, np.int64)


class Splitter:
    """Finds the words of Arrow text columns."""

    def __init__(self, kind: str, lower: bool = False, lane: int = 0):
        self.inside, self.hasher = tables()[kind], Hasher(lane)
        self.lower = np.arange(256, dtype=np.uint8)
        if lower:
            self.lower[0x41:0x5B] += 0x20

    def words(self, texts: pa.Array) -> Words:
        data, rows = utf8(texts)
        data = self.lower[data]
        inside = self.inside[data]
        edges = rows[:-1][rows[:-1] < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(rows, start, side="right") - 1
        hashes = self.hasher.ranges(self.hasher.sums(data), start, end)
        return Words(data, start, end, row, np.searchsorted(start, rows), hashes)


def runs(starts: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` places lie within any of the ranges [start, start + length)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """An Arrow list column: for each row the values whose ``row`` (ascending) names it."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
