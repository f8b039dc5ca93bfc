"""SentencePiece encoding, N-best segmentation and decoding.

A normalized text is a lattice of pieces; a path's score is the sum of its pieces' scores. No piece
spans the border before a space mark that follows another character, so the lattice falls into
chunks (a word with its leading space marks) whose segmentations combine freely.

Forward Viterbi scores of all new chunks of a slice are computed together; together with backward
scores they also say how much a chunk's second-best path loses. The best path of a text joins its
chunks' best paths. Its next-best segmentations can only differ in the chunks that lose least, as
many as there are further segmentations asked for; those chunks' N-best paths come from a backward
A-star search whose exact heuristic is the forward Viterbi score, so paths leave its queue in
order of score. Equal scores: the path whose ids, read from the end, are smaller; equal sums: the
text whose changes come later.

Characters without a piece are spelled as byte pieces, at a score below all pieces. Null texts are
empty: no pieces, one segmentation, score 0. Control pieces never appear. Memory follows the
longest text and a bounded cache of chunks. Repeated rows each give their row; other columns are
ignored. A text's own space marks (U+2581) come back as spaces, as the model defines.
"""

import hashlib
import heapq
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.wordscan import mix, slices

MARK = 0x2581
UNKNOWN_LOSS = 10.0
CACHE_CHUNKS = 1_000_000
BATCH_CHARS = 48
SLICE_BYTES = 1 << 20
SLOT_BITS = 19
SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
BASE = 0x9FB21C651E98DF25


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        ids = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.pieces = {p.id_to_piece(i): i for i in ids}
        self.scores = np.array([p.get_score(i) for i in range(p.get_piece_size())], np.float64)
        self.bytes = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.unknown = float(self.scores[ids].min() - UNKNOWN_LOSS) if ids else -UNKNOWN_LOSS
        self.longest = max(map(len, self.pieces), default=1)
        self.spanning = any(chr(MARK) in x[1:] and x.strip(chr(MARK)) for x in self.pieces)
        raw = [b""] * len(self.scores)
        for x, i in self.pieces.items():
            raw[i] = x.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        self.raw_ends = np.cumsum([len(x) for x in raw])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._index()

    def _index(self):
        """Piece ids by the hash of their characters."""
        self.up = np.cumprod(np.array([1] + [BASE] * BATCH_CHARS, np.uint64), dtype=np.uint64)
        down = pow(BASE, -1, 1 << 64)
        self.down = np.cumprod(np.array([1] + [down] * BATCH_CHARS, np.uint64), dtype=np.uint64)
        short = [(x, i) for x, i in self.pieces.items() if len(x) <= BATCH_CHARS]
        hashes = np.array([self.hashes(np.array([[ord(c) for c in x]], np.uint64))[0, -1] for x, _ in short], np.uint64)
        hashes = mix(hashes)
        order = np.argsort(hashes)
        self.known, self.ids = hashes[order], np.array([i for _, i in short], np.int64)[order]
        slots, first, run = np.unique(self.known >> SLOT_SHIFT, return_index=True, return_counts=True)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slots.astype(np.int64)] = first
        self.run = int(run.max(initial=1))
        self.known = np.append(self.known, np.zeros(self.run, np.uint64))

    def hashes(self, chars: np.ndarray) -> np.ndarray:
        """Running sums of each row's characters; column j covers the first j + 1."""
        return np.cumsum(mix(chars) * self.up[: chars.shape[1]], axis=1, dtype=np.uint64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        hashes = mix(hashes)
        found = np.full(len(hashes), -1)
        at = self.slots[(hashes >> SLOT_SHIFT).view(np.int64)]
        maybe = np.flatnonzero(at >= 0)
        at, hashes = at[maybe], hashes[maybe]
        for k in range(self.run):  # keys of one slot lie next to each other
            same = np.flatnonzero(self.known[at + k] == hashes)
            found[maybe[same]] = self.ids[at[same] + k]
        return found

    def spell(self, char: str) -> list[int]:
        return self.bytes[np.frombuffer(char.encode(), np.uint8)].tolist()


class Lattice:
    """The piece lattice of one chunk."""

    def __init__(self, model: Model, chunk: str):
        self.model, self.chunk = model, chunk
        n = len(chunk)
        self.ending = [[] for _ in range(n + 1)]  # (start, score, id or -1)
        for s in range(n):
            for e in range(s + 1, min(s + model.longest, n) + 1):
                i = model.pieces.get(chunk[s:e])
                if i is not None:
                    self.ending[e].append((s, float(model.scores[i]), i))
            if chunk[s] not in model.pieces:
                self.ending[s + 1].append((s, model.unknown, -1))
        self.forward = [0.0] + [-np.inf] * n
        for e in range(1, n + 1):
            self.forward[e] = max(self.forward[s] + score for s, score, _ in self.ending[e])

    def paths(self, number: int) -> list[tuple[float, list[int]]]:
        """The best ``number`` paths: backward from the end, guided by forward scores."""
        queue = [Open(-self.forward[-1], None, len(self.chunk), 0.0)]
        out = []
        while queue and len(out) < number:
            here = heapq.heappop(queue)
            if here.at == 0:
                ids, node = [], here
                while node.before is not None:
                    ids += [node.id] if node.id >= 0 else self.model.spell(self.chunk[node.at])
                    node = node.before
                out.append((here.score, ids))
                continue
            for s, step, i in self.ending[here.at]:
                heapq.heappush(queue, Open(-(self.forward[s] + step + here.score), here, s, here.score + step, i))
        return out


class Open:
    """A path from the end back to ``at``: its last piece and the path before it, which it shares with others.

    ``jump`` leads to a path further before, so that two paths part after a logarithmic number of steps.
    """

    __slots__ = ("order", "before", "at", "score", "id", "depth", "jump")

    def __init__(self, order: float, before: "Open | None", at: int, score: float, id: int = -1):
        self.order, self.before, self.at, self.score, self.id = order, before, at, score, id
        if before is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = before.depth + 1, before.jump
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def __lt__(self, other: "Open") -> bool:
        """By order; equal ones by their pieces (id, start) read from the end, a beginning before what it begins."""
        if self.order != other.order:
            return self.order < other.order
        depth = min(self.depth, other.depth)
        a, b = self._up(depth), other._up(depth)
        if a is b:
            return self.depth < other.depth
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return (a.id, a.at) < (b.id, b.at)

    def _up(self, depth: int) -> "Open":
        here = self
        while here.depth > depth:
            here = here.jump if here.jump.depth >= depth else here.before
        return here


class Segmenter:
    """Best paths of many chunks at once, kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.number, self.chunks, self.n_best, self.alike = {}, [], {}, {}
        self.flat, self.size = np.zeros(1 << 16, np.int64), 0
        self.ends, self.score, self.loss = (np.zeros(1 << 16, t) for t in (np.int64, np.float64, np.float64))

    def learn(self, chunks: list[str]):
        if len(self.number) > CACHE_CHUNKS:
            self._forget()
        new = [c for c in chunks if c not in self.number]
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        order, results = np.argsort(size, kind="stable"), []
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            length = int(size[own[0]])
            for part in np.array_split(own, -(-len(own) // 8192)):
                text = [new[k] for k in part]
                results.append(self._viterbi(text, length) if length <= BATCH_CHARS else self._one_by_one(text))
        new = [new[k] for k in order]
        ids, counts, scores, losses = (np.concatenate(x) for x in zip(*results))
        base, n = len(self.chunks), len(new)
        while base + n + 1 > len(self.ends):
            self.ends, self.score, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.score, self.loss))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.ends[base + 1 : base + 1 + n] = self.size + np.cumsum(counts)
        self.size += len(ids)
        self.score[base : base + n], self.loss[base : base + n] = scores, losses
        self.chunks += new
        self.number.update(zip(new, range(base, base + n)))

    def _one_by_one(self, chunks: list[str]):
        found = [Lattice(self.model, c).paths(2) for c in chunks]
        loss = [b[0][0] - b[1][0] if len(b) > 1 else np.inf for b in found]
        return np.array([i for b in found for i in b[0][1]]), [len(b[0][1]) for b in found], [b[0][0] for b in found], loss

    def _viterbi(self, chunks: list[str], n: int):
        """Of chunks of one length: ids of all best paths, how many each has, its score, what the second-best path loses."""
        model, rows = self.model, len(chunks)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(rows, n)
        sums = np.concatenate([np.zeros((rows, 1), np.uint64), model.hashes(chars.astype(np.uint64))], axis=1)
        edges = []
        forward = np.full((rows, n + 1), -np.inf)
        forward[:, 0] = 0
        start, piece = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -2)
        for e in range(1, n + 1):
            low = max(0, e - model.longest)
            spans = (sums[:, e : e + 1] - sums[:, low:e]) * model.down[low:e]
            ids = model.lookup(spans.ravel()).reshape(rows, e - low)
            bare = ids[:, -1] < 0
            score = np.where(ids >= 0, model.scores[ids], -np.inf)
            score[bare, -1] = model.unknown
            through = forward[:, low:e] + score
            best = through.max(axis=1)
            tied = np.where(through == best[:, None], ids, np.iinfo(np.int64).max)
            pick = tied.argmin(axis=1)
            forward[:, e], start[:, e], piece[:, e] = best, low + pick, ids[np.arange(rows), pick]
            edges.append((low, score))
        backward = np.full((rows, n + 1), -np.inf)
        backward[:, n] = 0
        for e in range(n, 0, -1):
            low, score = edges[e - 1]
            backward[:, low:e] = np.maximum(backward[:, low:e], score + backward[:, e : e + 1])
        on_path = np.zeros((rows, n + 1), bool)
        at = np.full(rows, n)
        count = np.zeros(rows, np.int64)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            on_path[live, at[live]] = True
            count[live] += 1
            at[live] = start[live, at[live]]
        second = np.full(rows, -np.inf)
        for e in range(1, n + 1):
            low, score = edges[e - 1]
            through = forward[:, low:e] + score + backward[:, e : e + 1]
            own = np.flatnonzero(on_path[:, e])
            through[own, start[own, e] - low] = -np.inf
            second = np.maximum(second, through.max(axis=1))
        loss = forward[:, n] - second
        row, end = np.nonzero(on_path)
        ids = piece[row, end]
        for k in np.flatnonzero(ids < 0)[::-1]:  # characters without a piece
            spelled = model.spell(chr(chars[row[k], end[k] - 1]))
            if len(spelled) > 1:
                ids = np.insert(ids, k + 1, spelled[1:])
                count[row[k]] += len(spelled) - 1
            ids[k] = spelled[0]
        return ids, count, forward[:, n], loss

    def best(self, number: int, count: int) -> list[tuple[float, list[int]]]:
        """The chunk's best ``count`` paths."""
        if number not in self.n_best:
            found = Lattice(self.model, self.chunks[number]).paths(count)
            spelled = {raw_text(self.model, np.array(ids, np.int64)) for _, ids in found}
            self.n_best[number], self.alike[number] = found, len(spelled) == 1
        return self.n_best[number]


def cut(chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and before a space mark that follows another character."""
    start = np.zeros(len(chars) + 1, bool)
    start[rows] = True
    mark = chars == MARK
    start[1:-1] |= mark[1:] & ~mark[:-1]
    return np.flatnonzero(start[:-1])


class Encoder:
    def __init__(self, path: str, count: int):
        self.model, self.count = Model(path), count
        self.segmenter = Segmenter(self.model)
        if self.model.spanning:
            raise ValueError("pieces of this model span words")

    def encode(self, texts: list[str]):
        """Per text, lazily: ids of the best segmentation, scores of the best ones, and their changes of chunks."""
        normal = self.model.processor.normalize(texts) if texts else []
        joined = "".join(normal)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        rows = np.append(0, np.cumsum([len(x) for x in normal]))
        starts = cut(chars, rows[:-1][np.diff(rows) > 0])
        ends = np.append(starts[1:], len(chars)) if len(starts) else starts
        chunks = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        s = self.segmenter
        s.learn(list(dict.fromkeys(chunks)))
        numbers = np.array([s.number[c] for c in chunks], np.int64)
        first = np.searchsorted(starts, rows)
        for r in range(len(texts)):
            own = numbers[first[r] : first[r + 1]]
            low, size = s.ends[own], s.ends[own + 1] - s.ends[own]
            base = np.append(0, np.cumsum(size))
            ids = s.flat[np.repeat(low - base[:-1], size) + np.arange(base[-1])]
            yield normal[r], ids, base, own

    def n_best(self, ids: np.ndarray, base: np.ndarray, own: np.ndarray) -> tuple[list[tuple[float, np.ndarray]], bool]:
        """The best segmentations of a text, given its chunks' best paths, and whether all spell the same bytes.

        They differ in whole chunks only, so it is enough to compare the bytes of those chunks' paths.
        """
        s = self.segmenter
        total = float(s.score[own].sum())
        loss = s.loss[own]
        open_ = np.flatnonzero(np.isfinite(loss))
        near = np.sort(open_[np.lexsort((-open_, loss[open_]))[: self.count - 1]])
        choices = [s.best(int(own[k]), self.count) for k in near]
        change = np.zeros(1)
        for c in choices:
            change = np.add.outer(change, [x - c[0][0] for x, _ in c])
        out = []
        for k in np.argsort(-change, axis=None, kind="stable")[: self.count]:
            ranks = np.unravel_index(k, change.shape)[1:]
            score = total + float(change.flat[k])
            parts, last = [], 0
            for k, c, r in zip(near, choices, ranks):
                if r:
                    parts += [ids[last : base[k]], np.array(c[r][1], np.int64)]
                    last = base[k + 1]
            out.append((score, np.concatenate([*parts, ids[last:]])))
        return out, all(s.alike[int(own[k])] for k in near)


def raw_text(model: Model, ids: np.ndarray) -> bytes:
    """The bytes that a sequence of ids spells."""
    ends = model.raw_ends[ids]
    size = ends - np.where(ids > 0, model.raw_ends[ids - 1], 0)
    place = np.cumsum(size) - size
    return model.raw[np.repeat(ends - size - place, size) + np.arange(size.sum())].tobytes() if len(ids) else b""


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
    raw = raw_text(model, ids)
    return raw[raw[:1] == b" " :].decode(errors="replace")


def worker_encoder(path: str, count: int) -> Encoder:
    """The Python worker's encoder, kept from task to task for the chunks it has learnt."""
    kept = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders"))
    if (path, count) not in kept.__dict__:
        kept.__dict__[(path, count)] = Encoder(path, count)
    return kept.__dict__[(path, count)]


def _encode(path: str, count: int, keep_ids: bool):
    def run(batches):
        encoder = worker_encoder(path, count)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                out = []
                for text, (normal, ids, base, own) in zip(texts, encoder.encode(texts)):
                    found, alike = encoder.n_best(ids, base, own)
                    decoded = decode(encoder.model, found[0][1])
                    same = alike and decoded == decode_normal(normal)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in found]
                    whole = hashlib.sha256(decoded.encode(errors="replace")).hexdigest()
                    out.append((len(ids), crc[0], [s for s, _ in found], crc, same, whole, found[0][1] if keep_ids else None))
                n, crc, scores, all_crc, same, whole, ids = zip(*out)
                columns = [
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(scores, pa.list_(pa.float64())),
                    pa.array(all_crc, pa.list_(pa.int64())), pa.array(same), pa.array(whole),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "scores", "crcs", "round_trip", "text_sha256"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def decode_normal(normal: str) -> str:
    plain = normal.replace(chr(MARK), " ")
    return plain[plain[:1] == " " :]


def encode_pieces(documents: DataFrame, model: str, count: int = 4, keep_ids: bool = False) -> DataFrame:
    """Per document: pieces and checksum of the best segmentation, scores and checksums of the best ``count``,
    whether all decode to the normalized text, and the decoded text's checksum (and the ids, if asked for)."""
    schema = (
        "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, crcs array<long>, round_trip boolean,"
        " text_sha256 string" + (", ids array<int>" if keep_ids else "")
    )
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_encode(model, count, keep_ids), schema)
    return found.withColumn("n_best", F.size("scores").cast("long"))
