"""Removal of byte strings that occur twice, decided by suffix arrays.

A string of ``length`` bytes is removed where it also starts anywhere else. Equal strings hold the
same least gram at the same place (the least hash of ``GRAM`` bytes in it), so each starting byte
belongs to the segment around its least gram, and segments are compared only where their gram may
occur twice (a count-min sketch over all documents' grams says where; it misses none).

Segments of one gram are brought together. Equal segments settle each other whole. Those that differ
are cut to the runs of strings whose hashes come twice, and a suffix array over these decides: suffixes are put in groups by their Lyndon prefix, groups are
taken in descending order, each extends the groups of its members' previous smaller suffixes, and
a last ascending pass places every suffix by the same pointers, without renaming or recursion.
Neighbours in it that agree on ``length`` bytes are the strings that occur twice.

Null texts are empty. Repeated rows are places of their own, so a text of enough bytes that comes
twice is removed in both rows. A null id is kept. Other columns are ignored. Work and memory in a
shard follow its distinct segments; a segment that very many documents share is sent once by
each chunk of keys.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.sketch import PACKED, chunks, deal, repeated_keys, resolve, shard_of, shards_for
from flowlens.llm.substrings import NO_ID, identified
from flowlens.llm.wordscan import Hasher, mix, runs, slices, utf8

GRAM = 40
KEYS_PER_CHAR = 0.014
SEGMENTS_PER_CHAR = 0.01
ARRAY_BYTES = 1 << 17
PORTION_BYTES = 1 << 20


def grouping_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of small numbers by Lyndon-prefix groups; a prefix sorts before what it begins."""
    n = len(text)
    group = [0] * n
    members, after, before = [], [], []
    last = -1
    order = np.argsort(text, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if n else ():
        for i in part.tolist():
            group[i] = len(members)
        members.append(part.tolist())
        before.append(last)
        after.append(-1)
        if last >= 0:
            after[last] = len(members) - 1
        last = len(members) - 1
    previous, skip = [-1] * n, list(range(n))  # skip[i]: i, or an earlier place to look from once i's group is done
    at, ranked = last, []
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        ranked.append((at, len(own)))
        for i in own:
            skip[i] = i - 1
        votes = {}
        for i in own:
            j = i - 1
            while j >= 0 and skip[j] != j:
                if skip[j] >= 0:
                    skip[j] = skip[skip[j]]
                j = skip[j]
            previous[i] = j
            if j >= 0:
                votes[j] = votes.get(j, 0) + 1
        if votes:
            by = {}
            for j, number in votes.items():
                by.setdefault(number, {}).setdefault(group[j], []).append(j)
            for number in sorted(by, reverse=True):
                for old, moved in by[number].items():
                    new = len(members)
                    members.append(moved)
                    for j in moved:
                        group[j] = new
                    following = after[old]
                    before.append(old)
                    after.append(following)
                    after[old] = new
                    if following >= 0:
                        before[following] = new
        at = before[at]
    free, place = [0] * len(members), 0
    for number, size in reversed(ranked):
        free[number] = place
        place += size
    array, placed = [-1] * n, [False] * n
    heads = -1
    while heads < n:
        j = (n if heads < 0 else array[heads]) - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            array[free[group[j]]] = j
            free[group[j]] += 1
            j = previous[j]
        heads += 1
    return np.array(array, np.int64)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct strings, at which of its starting bytes a string of ``length`` begins that begins elsewhere too."""
    sizes = np.array([len(s) for s in segments])
    base = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:] = raw.astype(np.int16) + 1
    text[base + sizes] = 0
    order = grouping_order(text)
    starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(base, sizes)])
    asked = np.zeros(len(text), bool)
    asked[starts] = True
    order = order[asked[order]]
    same = np.zeros(max(len(order) - 1, 0), bool)
    for a in range(0, len(same), 10_000):
        x, y = order[a : a + 10_000], order[a + 1 : a + 10_001]
        x, y = x[: len(y)], y
        same[a : a + len(y)] = (text[x[:, None] + np.arange(length)] == text[y[:, None] + np.arange(length)]).all(axis=1)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [twice[b : b + s - length + 1] for b, s in zip(base, sizes)]


def contest(texts: list[bytes], gram: np.ndarray, count: np.ndarray, copied: np.ndarray, length: int) -> list[np.ndarray]:
    """For distinct segments of one gram: which of their starting bytes' strings occur twice.

    Strings can only be equal where they lie the same way around the gram. While the segments are too
    many bytes for one suffix array, the ways are halved, and the parts that are then equal settle each other.
    """
    marks = [np.zeros(n, bool) for n in count]
    stack = [(0, int(gram.max()) + 1, range(len(texts)))]
    while stack:
        low, high, own = stack.pop()
        parts = {}
        for k in own:
            first, last = max(0, int(gram[k]) - high + 1), min(int(count[k]) - 1, int(gram[k]) - low)
            if first <= last:
                parts.setdefault((int(gram[k]) - first, texts[k][first : last + length]), []).append((k, first, last))
        single = []
        for (_, text), same in parts.items():
            if len(same) > 1 or copied[same[0][0]]:
                for k, first, last in same:
                    marks[k][first : last + 1] = True
            single.append((text, *same[0]))
        if len(single) < 2 or high - low == 1:
            continue
        if sum(len(x[0]) for x in single) <= ARRAY_BYTES:
            for (_, k, first, last), twice in zip(single, repeated_starts([x[0] for x in single], length)):
                marks[k][first : last + 1] |= twice
        else:
            middle, every = (low + high) // 2, [k for _, k, _, _ in single]
            stack += [(low, middle, every), (middle, high, every)]
    return marks


def _portions(key: np.ndarray, size: np.ndarray):
    """Slices of whole keys (sorted), of about ``PORTION_BYTES`` each."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    before, first = np.append(0, np.cumsum(size)), 0
    for at, following in zip(starts, [*starts[1:], len(key)]):
        if before[following] - before[first] > PORTION_BYTES or following == len(key):
            yield slice(int(first), int(following))
            first = following


def candidates(texts: list[bytes], key, gram, count, copied, length: int):
    """Runs (segment, first, number) of starting bytes whose strings' hashes come twice for one gram and way around it."""
    hasher, data = Hasher(), np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *map(len, texts)])[:-1]
    owner = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = base[owner] + inner
    way = (gram[owner] - inner).astype(np.uint64)
    code = hasher.ranges(hasher.sums(data), starts, starts + length) ^ mix(key[owner] + way)
    order = np.argsort(code, kind="stable")
    new = np.append(True, code[order][1:] != code[order][:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=1 + copied[owner[order]]) > 1
    hit = np.zeros(len(code), bool)
    hit[order] = many[group]
    edge = np.append(True, owner[1:] != owner[:-1])
    first = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    last = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
    return owner[first], inner[first], last - first + 1


def decide(own: np.ndarray, c: dict, copied: np.ndarray, runs_of, length: int):
    """(row, first, number) of the starting bytes of uncopied segments that a suffix array confirms."""
    segment, first, number = runs_of
    key = c["key"][own][segment]
    out = ([], [], [])
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
    for a, b in zip(edges, [*edges[1:], len(key)]):
        s, f, n = segment[a:b], first[a:b], number[a:b]
        texts = [c["text"][own[k]][x : x + y + length - 1] for k, x, y in zip(s, f, n)]
        marks = contest(texts, c["gram"][own[s]] - f, n, copied[s], length)
        for k, x, twice in zip(s, f, marks):
            if copied[k] or not twice.any():
                continue
            ends = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
            for low, high in zip(ends[::2], ends[1::2]):
                for values, value in zip(out, (int(own[k]), int(x + low), int(high - low))):
                    values.append(value)
    return out


class Grams:
    """Least grams of the strings of ``length`` bytes of a slice of texts."""

    def __init__(self, length: int):
        self.length, self.gram, self.hasher = length, min(GRAM, length), Hasher()

    def segments(self, texts: pa.Array):
        """Data, rows' offsets, and per segment: row, key, first starting byte, number of starting bytes."""
        data, rows = utf8(texts)
        sums = self.hasher.sums(data)
        found = []
        sizes = np.diff(rows)
        n = len(data) - self.gram + 1
        if n <= 0 or not (sizes >= self.length).any():
            none = np.zeros(0, np.int64)
            return data, rows, none, none.astype(np.uint64), none, none
        at = np.arange(n)
        keys = self.hasher.ranges(sums, at, at + self.gram)
        width = self.length - self.gram + 1
        least = _sliding_least(keys, width)
        strings = np.maximum(sizes - self.length + 1, 0)
        row = np.repeat(np.arange(len(sizes)), strings)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
        starts = rows[row] + inner
        value = least[starts]
        new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
        # a run of equal least values may span several equal grams: cut it where the first of them leaves the string
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        place = starts[first] + np.lib.stride_tricks.sliding_window_view(keys, width)[starts[first]].argmin(axis=1)
        several = place < starts[first + count - 1]
        for a, c in zip(first[several].tolist(), count[several].tolist()):
            found.extend(self._cuts(keys, starts[a : a + c], width, a))
        if found:
            new[np.array(found)] = True
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(starts)))
        return data, rows, row[first], value[first], starts[first], count

    def place(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How far after their first byte the least grams of segments begin."""
        at = first[:, None] + np.arange(self.length - self.gram + 1)
        return self.hasher.ranges(self.hasher.sums(data), at.ravel(), at.ravel() + self.gram).reshape(at.shape).argmin(axis=1)

    @staticmethod
    def _cuts(keys, starts, width, a):
        """Where the leftmost least gram changes within a run of starts whose least values are equal."""
        value, out, i = keys[starts[0] : starts[0] + width].min(), [], 0
        equal = starts[0] + np.flatnonzero(keys[starts[0] : starts[-1] + width] == value)
        while i < len(starts):
            leftmost = equal[np.searchsorted(equal, starts[i])]
            i = int(leftmost - starts[0]) + 1
            if i < len(starts):
                out.append(a + i)
        return out


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _gram_keys(length: int):
    def maker():
        grams = Grams(length)

        def extract(texts):
            _, _, row, key, _, _ = grams.segments(texts)
            return row, key

        return extract

    return maker


def _send_segments(length: int, shards: int):
    def run(batches):
        grams, second = Grams(length), Hasher(1)

        def columns(part):
            data, rows, row, key, first, count = grams.segments(part.column("text"))
            suspects = part.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.isin(key, suspects)
            row, key, first, count = row[own], key[own], first[own], count[own]
            end = first + count + length - 1
            one = grams.hasher.ranges(grams.hasher.sums(data), first, end)
            two = second.ranges(second.sums(data), first, end)
            raw = data.tobytes()
            text = np.empty(len(first), object)
            text[:] = [raw[a:b] for a, b in zip(first, end)]
            return {
                "rid": part.column("rid").to_numpy()[row], "key": key, "one": one, "two": two,
                "place": first - rows[row], "count": count, "text": text, "gram": grams.place(data, first),
            }

        for chunk in chunks(batches, columns, CHUNK_SEGMENTS):
            yield from _settle(chunk, shards)

    return run


CHUNK_SEGMENTS = 1 << 16


def _settle(chunk: dict, shards: int):
    """Sends each distinct segment of a chunk once, with its places."""
    order = np.lexsort((chunk["rid"], chunk["two"], chunk["one"], chunk["key"]))
    chunk = {name: x[order] for name, x in chunk.items()}
    new = np.append(True, (chunk["key"][1:] != chunk["key"][:-1]) | (chunk["one"][1:] != chunk["one"][:-1]) | (chunk["two"][1:] != chunk["two"][:-1]))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(new))) > 1
    twice = many[np.cumsum(new) - 1]
    head = {name: x[first] for name, x in chunk.items()} | {"copies": 1 + many.astype(np.int64)}
    head["ask"] = ~many
    yield from deal(shard_of(head["key"], shards), shards, head)
    if twice.any():  # equal within the chunk: every place is settled
        sure = {name: x[twice] for name, x in chunk.items()} | {"copies": np.zeros(twice.sum(), np.int64), "ask": np.zeros(twice.sum(), bool)}
        sure["text"] = np.full(twice.sum(), b"", object)
        order = np.argsort(sure["rid"], kind="stable")
        yield from deal(shard_of(mix(sure["rid"][order].view(np.uint64)), shards), shards, {name: x[order] for name, x in sure.items()})


def _judge(length: int):
    """Ranges of starting bytes whose strings occur twice, as first byte * 2^32 + number."""

    def work(columns):
        out_rid, out_range = [], []
        sure = columns["copies"] == 0
        out_rid.append(columns["rid"][sure])
        out_range.append((columns["place"][sure] << 32) + columns["count"][sure])
        c = {name: x[~sure] for name, x in columns.items()}
        order = np.lexsort((c["two"], c["one"], c["key"]))
        c = {name: x[order] for name, x in c.items()}
        if len(order):
            new_key = np.append(True, c["key"][1:] != c["key"][:-1])
            new = new_key | np.append(True, (c["one"][1:] != c["one"][:-1]) | (c["two"][1:] != c["two"][:-1]))
            segment = np.cumsum(new) - 1
            copies = np.bincount(segment, weights=c["copies"]) > 1
            settled = copies[segment] & c["ask"]
            out_rid.append(c["rid"][settled])
            out_range.append((c["place"][settled] << 32) + c["count"][settled])
            heads = np.flatnonzero(new)
            kinds = np.bincount(np.cumsum(new_key)[heads] - 1)  # distinct segments of each gram
            contested = heads[kinds[np.cumsum(new_key)[heads] - 1] > 1]
            for own in _portions(c["key"][contested], c["count"][contested] + length):
                own = contested[own]
                runs_of = candidates(c["text"][own].tolist(), c["key"][own], c["gram"][own], c["count"][own], copies[segment[own]], length)
                for h, first, number in zip(*decide(own, c, copies[segment[own]], runs_of, length)):
                    out_rid.append(c["rid"][h : h + 1])
                    out_range.append(np.array([((int(c["place"][h]) + first) << 32) + number]))
        return np.concatenate(out_rid), np.concatenate(out_range).astype(np.int64)

    return work


def repeated_bytes(texts: DataFrame, length: int = 200) -> DataFrame:
    """(rid, ranges): starting bytes of each row's strings that occur twice, as first * 2^32 + number."""
    suspects = repeated_keys(texts, _gram_keys(length), KEYS_PER_CHAR, by_row=False)
    shards = shards_for(texts, SEGMENTS_PER_CHAR, CHUNK_SEGMENTS)
    packed = texts.join(suspects, "rid").mapInArrow(_send_segments(length, shards), PACKED)
    return resolve(packed, shards, _judge(length), "ranges")


def _digest(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, own in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    raw = (text or "").encode()
                    gone = spans = 0
                    if own:
                        own = np.array(own, np.int64)
                        marks = runs(own >> 32, (own & 0xFFFFFFFF) + length - 1, len(raw))
                        spans = int((np.diff(np.append(0, marks.astype(np.int8))) == 1).sum())
                        gone = int(marks.sum())
                        size, raw = len(raw), np.frombuffer(raw, np.uint8)[~marks].tobytes()
                    else:
                        size = len(raw)
                    out.append((size, gone, spans, hashlib.sha256(raw).hexdigest()))
                size, gone, spans, digest = zip(*out)
                doc = part.column("doc").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == NO_ID), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(digest)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def suffix_dedup(documents: DataFrame, length: int = 200) -> DataFrame:
    """Per document: its bytes, those removed, the number of removed runs, and the checksum of the rest."""
    texts = identified(documents)
    marked = texts.join(repeated_bytes(texts, length), "rid", "left").select("doc", "text", "ranges")
    return marked.mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
