"""Token-id files with a minimal perfect hash index.

Documents are sorted by id over the cluster; every partition writes one shard file to the shared
folder: raw ids (16 bits where the vocabulary allows, else 32), the ids' places, and an index
that maps each document key to its entry. The index is a minimal perfect hash: keys that fall
alone on a bit of a level keep it, the others go on to the next level, and the number of set bits
before a key's bit is its slot. A slot stores a fingerprint of the key, so unknown keys are
turned away, and the entry's number; a lookup reads a few bytes whatever the size of the shard.

Shards are written under unique names and named in a manifest table only when their task has
succeeded, so repeated or lost tasks leave no trace in it. Memory follows the number of documents
of a partition (some 40 bytes each) and the longest document, never the payload.

Encoding splits texts as the byte-level pre-tokenizer does, on numpy code points, and gives each
distinct piece to the tokenizer once; texts that hold the spelling of an added token go to it whole.
Null texts are empty: the end id alone. A null id is written first and cannot be looked up.
Repeated ids lie next to each other; the index gives the first and their number.
"""

import io
import sys
import types
import unicodedata
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm.wordscan import Hasher, mix, slices, utf8
from flowlens.session import materialize, scratch_path

MAGIC = b"FLTOKEN1"
CACHE_PIECES = 1_000_000
SLICE_BYTES = 1 << 19
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: Endings that the pre-tokenizer splits after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


class Pieces:
    """Where byte-level pre-tokenization cuts the texts of a slice."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, np.uint8)

    def kind(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        for c in np.unique(points[kinds == 0]) if not kinds.all() else ():
            category, char = unicodedata.category(chr(c))[0], chr(c)
            space = char.isspace() and not 0x1C <= c <= 0x1F
            self.kinds[c] = SPACE if space else {"L": LETTER, "N": NUMBER}.get(category, OTHER)
        return self.kinds[points]

    def cut(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces start; the pieces of a row never reach into the next."""
        if not len(data):
            return np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(at, rows)] = True
        kind = self.kind(points)
        blank = kind == SPACE
        same = np.zeros(len(points), bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:-1]
        after_blank = np.zeros(len(points), bool)
        after_blank[1:] = (points[:-1] == 0x20) & ~first[1:-1]
        start = np.where(blank, ~same, ~same & ~after_blank)
        last = np.zeros(len(points), bool)
        last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:-1]
        start |= last
        self._endings(points, kind, first, start)
        return at[start]

    def _endings(self, points, kind, first, start):
        n = len(points)
        mark = np.flatnonzero((points == 0x27) & start)
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
        for ending in ENDINGS:
            here = mark[mark + len(ending) < n]
            for j, c in enumerate(ending):
                here = here[(points[here + 1 + j] == ord(c)) & ~first[here + 1 + j]]
            start[here + 1] = False
            here = here[here + 1 + len(ending) < n] + 1 + len(ending)
            start[here[(kind[here] == LETTER) & ~first[here]]] = True
        return start


class Encoder:
    """Ids of many texts; every distinct piece is encoded once while it stays in the cache.

    Pieces that begin with a space are handed over as one text, as each is cut off at its space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.hasher = Tokenizer.from_file(path), Pieces(), Hasher()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.known, self.flat, self.size, self.ends = {}, np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.int64)

    def _learn(self, pieces: list[bytes]):
        if len(self.known) > CACHE_PIECES:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        parted = [len(p) > 1 and p[0] == 0x20 and not p[1:].decode()[0].isspace() for p in new]
        new = [p for p, own in zip(new, parted) if own] + [p for p, own in zip(new, parted) if not own]
        joined = sum(parted)
        texts = [b"".join(new[:joined]).decode(), *[p.decode() for p in new[joined:]]]
        first, *rest = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        sizes = np.concatenate([np.bincount(np.array(first.word_ids, np.int64), minlength=joined), [len(e.ids) for e in rest]]).astype(np.int64)
        flat = np.array([*first.ids, *[i for e in rest for i in e.ids]], np.uint32)
        if len(sizes) != len(new):
            raise ValueError("the tokenizer cuts pieces otherwise")
        while self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        n = len(self.known)
        self.ends[n + 1 : n + 1 + len(new)] = self.size + np.cumsum(sizes)
        self.flat[self.size : self.size + len(flat)] = flat
        self.size += len(flat)
        self.known.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many belong to each text."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for word in self.added:
            whole |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        data, rows = utf8(texts)
        start = self.pieces.cut(data, rows)
        end = np.append(start[1:], len(data))
        hashes = self.hasher.ranges(self.hasher.sums(data), start, end)
        _, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[sample], end[sample])]
        self._learn(pieces)
        number = np.array([self.known[p] for p in pieces], np.int64)[inverse]
        low, count = self.ends[number], self.ends[number + 1] - self.ends[number]
        place = np.cumsum(count) - count
        ids = self.flat[np.repeat(low - place, count) + np.arange(count.sum())]
        row = np.searchsorted(rows, start, side="right") - 1
        counts = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)
        for r in np.flatnonzero(whole):
            own = np.array(self.tokenizer.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, np.uint32)
            first = counts[:r].sum()
            ids = np.concatenate([ids[:first], own, ids[first + counts[r] :]])
            counts[r] = len(own)
        return ids, counts


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; ``bits`` are its levels one after another."""

    sizes: list[int]
    bits: np.ndarray
    ranks: np.ndarray
    block: int = 512

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))[0]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, sizes, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate([*levels, np.zeros(0, bool)])
        padded = np.append(bits, np.zeros(-len(bits) % 512, bool)).reshape(-1, 512)
        return cls(sizes, np.packbits(padded.ravel(), bitorder="little"), np.cumsum(padded.sum(1)) - padded.sum(1))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any number, or -1, for keys that are not in the set."""
        slot, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(keys[open_], level, size)
            hit = (self.bits[at >> 3] >> (at & 7)) & 1 == 1
            slot[open_[hit]] = self._rank(at[hit])
            open_, base = open_[~hit], base + size
        return slot

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // self.block
        rows = self.bits.reshape(-1, self.block // 8)[block]
        ones = np.unpackbits(rows, axis=1, bitorder="little") if len(rows) else np.zeros((0, self.block), np.uint8)
        before = np.arange(self.block) < (at % self.block)[:, None]
        return self.ranks[block] + (ones * before).sum(1)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard file: ``write`` streams ids, ``close`` adds the index; reading is by key or in order."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)

    def create(self, width: int):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.counts, self.keys = self.fs.open_output_stream(self.path), width, [], []
        self.out.write(MAGIC + bytes([width]))
        return self

    def write(self, keys: list, ids: np.ndarray, counts: np.ndarray):
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.counts.append(counts)

    def close(self) -> tuple[int, int]:
        keys = [k for part in self.keys for k in part]
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        starts = np.append(0, np.cumsum(counts))
        nulls = sum(k is None for k in keys)
        ids = np.array(keys[nulls:], np.int64)
        distinct, first, repeats = np.unique(ids, return_index=True, return_counts=True)
        index = PerfectHash.build(distinct.view(np.uint64))
        slot = index.slots(distinct.view(np.uint64))
        entry, marks, number = (np.zeros(len(distinct), t) for t in (np.int64, np.uint32, np.int64))
        entry[slot], marks[slot], number[slot] = first + nulls, fingerprints(distinct.view(np.uint64)), repeats
        packed = io.BytesIO()
        np.savez(packed, starts=starts, keys=ids, nulls=nulls, sizes=np.array(index.sizes, np.int64), bits=index.bits,
                 ranks=index.ranks, entry=entry, marks=marks, number=number)
        self.out.write(packed.getvalue())
        self.out.write(packed.tell().to_bytes(8, "little"))
        self.out.close()
        return len(keys), int(starts[-1])

    def open(self):
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        head = self.file.read_at(len(MAGIC) + 1, 0)
        if head[:-1] != MAGIC:
            raise ValueError(f"no token file: {self.path}")
        self.width = head[-1]
        self.index = dict(np.load(io.BytesIO(self.file.read_at(length, size - 8 - length))))
        self.hash = PerfectHash(self.index["sizes"].tolist(), self.index["bits"], self.index["ranks"])
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of each key and how many entries it has; 0 for keys that are not there."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.index["marks"][slot[known]] == fingerprints(keys[known])
        entry, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        entry[known], number[known] = self.index["entry"][slot[known]], self.index["number"][slot[known]]
        return entry, number

    def ids(self, entry: int, entries: int = 1) -> np.ndarray:
        low, high = self.index["starts"][entry], self.index["starts"][entry + entries]
        raw = self.file.read_at(int(high - low) * self.width, len(MAGIC) + 1 + int(low) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def worker_encoder(path: str) -> Encoder:
    """The Python worker's encoder, kept from task to task for the pieces it has learnt."""
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def _write(path: str, folder: str, end_id: int):
    def run(batches):
        encoder = worker_encoder(path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard, part = None, TaskContext.get().partitionId()
        name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                shard = shard or Shard(name).create(width)
                ids, counts = encoder.encode(rows.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                shard.write(rows.column("doc_id").to_pylist(), ids, counts + 1)
        if shard:
            docs, tokens = shard.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [docs], "n_ids": [tokens]})

    return run


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns their manifest: part (ascending ids), path, documents, ids, first id's place."""
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    written = materialize(
        rows.mapInArrow(_write(tokenizer, folder, end_id), "part long, path string, n_docs long, n_ids long"), "manifest"
    )
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return written.withColumn("start", F.coalesce(before, F.lit(0)))


def _digest(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            shard = Shard(path).open()
            keys, nulls = shard.index["keys"], int(shard.index["nulls"])
            entry, number = shard.find(keys)
            rank = np.arange(len(keys)) + nulls - entry
            if not ((rank >= 0) & (rank < number)).all():
                raise ValueError(f"index and entries differ: {path}")
            entries = [*range(nulls), *(entry + rank).tolist()]
            starts = shard.index["starts"]
            crc = [zlib.crc32(shard.ids(e).tobytes()) for e in entries]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * nulls + keys.tolist(), pa.int64()), pa.array(start + starts[entries], pa.int64()),
                 pa.array(np.diff(starts)[entries], pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def digest_token_files(manifest: DataFrame) -> DataFrame:
    """Reads every document back from the shards, by key: its place among all ids, length and checksum."""
    spread = manifest.repartition(manifest.count() or 1, "part")
    return spread.select("path", "start").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(manifest: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the documents of a few keys, from whichever shards hold them."""
    found = {}
    for row in manifest.select("path").toLocalIterator():
        shard = Shard(row.path).open()
        for key, entry, number in zip(keys, *shard.find(np.array(keys, np.int64))):
            if number and shard.index["keys"][entry - int(shard.index["nulls"])] == key:
                found[key] = [shard.ids(entry + i) for i in range(number)]
    return found
