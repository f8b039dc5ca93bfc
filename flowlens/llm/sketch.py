"""Keys that may occur more than once, found by count-min sketches that are merged by key range.

Every task turns its rows into 64-bit keys, a chunk of about a million keys at a time. A key
that repeats within a chunk is settled there. Of the others the chunk sends one packed list to
each shard (a range of keys): the key and the row it came from. A shard adds up the
chunks' counts in a count-min sketch and answers with the places of all keys whose estimate
reaches two. Estimates are never too low, so no repeated key is lost; a few single ones pass.

A chunk sends a key once, whatever number of rows hold it, so a key that a third of all rows
share costs a shard one entry for each chunk. Shards are as many as the keys need, so a shard's
memory is bounded; nothing is broadcast or brought to the driver.
"""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.wordscan import mix, slices

CHUNK_KEYS = 1 << 18
SHARD_KEYS = 1 << 19
DEPTH = 2
PACKED = "shard long, payload binary"
SKETCH, ASK, SURE = 0, 1, 2
OF_A_ROW = ("rid", "doc")


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Even shards, also of keys that are the least of many hashes and so have small values."""
    key = mix(key)
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def deal(shard: np.ndarray, shards: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packs rows of columns into one payload for each shard; ids of runs of equal ``rid`` are sent once."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        at = order[edges[s] : edges[s + 1]]
        own = {name: values[at] for name, values in columns.items()}
        new = np.flatnonzero(np.append(True, own["rid"][1:] != own["rid"][:-1]))
        runs = np.diff(np.append(new, len(at))).astype(np.uint32)
        own = {name: (values[new], runs) if name in OF_A_ROW else _small(values) for name, values in own.items()}
        payload = pa.array([pickle.dumps(own, protocol=5)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), payload], ["shard", "payload"])


def _small(values: np.ndarray):
    """Half as many bytes for long integers that need no more; ``_whole`` undoes it."""
    short = values.dtype == np.int64 and values.min() >= 0 and values.max() < 1 << 32
    return (values.astype(np.uint32), None) if short else values


def _whole(packed) -> np.ndarray:
    if not isinstance(packed, tuple):
        return packed
    return packed[0].astype(np.int64) if packed[1] is None else np.repeat(*packed)


def _stack(parts: list[dict]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([_whole(p[name]) for p in parts]) for name in parts[0]}


def gather(packed: DataFrame, shards: int, work: Callable, schema: str) -> DataFrame:
    """Brings each shard's payloads together and yields ``work(columns)``'s batches; one shard in memory at a time."""

    def run(batches):
        current, parts = None, []
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if shard != current and parts:
                    yield from work(_stack(parts))
                    parts = []
                current = shard
                parts.append(pickle.loads(payload.as_buffer()))
        if parts:
            yield from work(_stack(parts))

    return packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def resolve(packed: DataFrame, shards: int, work: Callable, name: str) -> DataFrame:
    """(rid, list): gathers shards, gets ``work(columns)``'s rids and values, and lists the values of each rid."""

    def answer(columns):
        rid, value = work(columns)
        order = np.argsort(rid, kind="stable")
        rid, value = rid[order], value[order]
        yield from deal(shard_of(mix(rid.view(np.uint64)), shards), shards, {"rid": rid, "value": value})

    answers = gather(packed, shards, answer, PACKED)
    return gather(answers, shards, lambda columns: listed(columns["rid"], columns["value"], name), f"rid long, {name} array<long>")


def listed(rid: np.ndarray, values: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """One row for each rid with the list of its values."""
    order = np.argsort(rid, kind="stable")
    rid, values = rid[order], values[order]
    first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1])) if len(rid) else np.zeros(0, np.int64)
    offsets = np.append(first, len(rid)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    for a in range(0, len(first), 1000):
        part = slice(a, a + 1000)
        yield pa.RecordBatch.from_arrays([pa.array(rid[first[part]]), lists[part]], ["rid", name])


def shards_for(texts: DataFrame, keys_per_char: float, shard_keys: int = SHARD_KEYS) -> int:
    """Shards that hold about ``shard_keys`` keys each, by the length of all texts."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, int(total * keys_per_char / shard_keys))


def chunks(batches, columns: Callable, size: int = CHUNK_KEYS):
    """Column arrays of about ``size`` rows, from ``columns(slice of a batch)``."""
    held, rows = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            held.append(columns(part))
            rows += len(held[-1]["rid"])
            if rows >= size:
                yield {name: np.concatenate([x[name] for x in held]) for name in held[0]}
                held, rows = [], 0
    if rows:
        yield {name: np.concatenate([x[name] for x in held]) for name in held[0]}


def _send(maker: Callable, shards: int, by_row: bool):
    def run(batches):
        extract = maker()

        def columns(part):
            row, key = extract(part.column("text"))
            return {"rid": part.column("rid").to_numpy()[row], "key": key}

        for chunk in chunks(batches, columns):
            order = np.argsort(chunk["key"], kind="stable")
            rid, key = chunk["rid"][order], chunk["key"][order]
            new = np.append(True, key[1:] != key[:-1])
            if by_row:  # a key's further places in the same row say nothing new
                keep = new | np.append(True, rid[1:] != rid[:-1])
                rid, key, new = rid[keep], key[keep], new[keep]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(key))) > 1
            entry = np.where(many, SKETCH, ASK).astype(np.uint8)
            one = np.argsort(rid[first], kind="stable")
            own = {"rid": np.where(many, 0, rid[first]), "key": key[first], "kind": entry}
            yield from deal(shard_of(key[first][one], shards), shards, {name: x[one] for name, x in own.items()})
            rest = many[np.cumsum(new) - 1]
            if rest.any():
                sure = {"rid": rid[rest], "key": key[rest], "kind": np.full(rest.sum(), SURE, np.uint8)}
                order = np.argsort(sure["rid"], kind="stable")
                sure = {name: x[order] for name, x in sure.items()}
                yield from deal(shard_of(mix(sure["rid"].view(np.uint64)), shards), shards, sure)

    return run


def _answer(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, kind = columns["key"], columns["kind"]
    counted = kind != SURE
    weight = np.where(kind == SKETCH, 2.0, 1.0)[counted]
    width = 1 << max(10, int(np.ceil(np.log2(8 * counted.sum() + 1))))
    estimate = np.full(len(key), np.inf)
    for row in range(DEPTH):
        cell = (mix(key ^ mix(np.array([row + 77], np.uint64))[0]) & np.uint64(width - 1)).astype(np.int64)
        counts = np.bincount(cell[counted], weights=weight, minlength=width)
        estimate = np.minimum(estimate, counts[cell])
    found = (kind == SURE) | ((kind == ASK) & (estimate >= 2))
    return columns["rid"][found], key[found].view(np.int64)


def repeated_keys(texts: DataFrame, maker: Callable, keys_per_char: float, by_row: bool, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(rid, keys): keys of each row that may occur in another row too (``by_row``) or at another place at all.

    ``texts`` has ``rid`` (long) and ``text``; ``maker()`` gives a function from a text column to arrays of row
    numbers (ascending) and 64-bit keys. Rows without such keys are left out.
    """
    shards = shards_for(texts, keys_per_char, shard_keys)
    packed = texts.select("rid", "text").mapInArrow(_send(maker, shards, by_row), PACKED)
    return resolve(packed, shards, _answer, "keys")
