"""Removal of word windows that start in an earlier document, with a count-min prefilter.

Windows are ``window`` consecutive words of one document. Equal windows hold the same least
five-word gram, so a window can only be repeated where its least gram is: the sketch counts the
least grams (about a fifth of the words) and so overestimates every window's count. A second
pass groups exactly (128-bit hashes) only the windows whose gram is estimated to be repeated and
finds each window's smallest document. Nothing repeated is lost, and windows are judged on the
input.

Null texts have no words. A null id counts as larger than every other (ids equal to the largest
64-bit integer are read as null). Repeated rows are judged like any others; a window repeated
within one id alone stays. Other columns are ignored, or kept by ``remove_repeats``.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.sketch import PACKED, chunks, deal, repeated_keys, resolve, shard_of, shards_for
from flowlens.llm.wordscan import Hasher, Splitter, mix, runs, slices

GRAM = 5
NO_ID = (1 << 63) - 1
KEYS_PER_CHAR = 0.04
WINDOWS_PER_CHAR = 0.03


def least_grams(words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the place of its least gram, and the hashes of all grams."""
    hashes = words.grams(gram)
    starts = words.starts(window)
    if not len(starts):
        return starts, starts, hashes
    spans = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1)
    return starts, starts + spans[starts].argmin(axis=1), hashes


def _gram_keys(window: int, gram: int):
    def maker():
        splitter = Splitter("plain")

        def extract(texts):
            words = splitter.words(texts)
            _, least, hashes = least_grams(words, window, gram)
            least = least[np.append(True, least[1:] != least[:-1])] if len(least) else least
            return words.row[least], hashes[least]

        return extract

    return maker


def _send_windows(window: int, gram: int, shards: int):
    def run(batches):
        splitter, second = Splitter("plain"), Hasher(1)

        def columns(part):
            words = splitter.words(part.column("text"))
            starts, least, hashes = least_grams(words, window, gram)
            suspects = part.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = starts[np.isin(hashes[least], suspects)]
            other = second.ranges(second.sums(words.data), words.start, words.end)
            row = words.row[starts]
            return {
                "rid": part.column("rid").to_numpy()[row], "doc": part.column("doc").to_numpy()[row],
                "place": starts - words.first[row], "one": words.grams(window)[starts], "two": words.grams(window, other)[starts],
            }

        for chunk in chunks(batches, columns):
            late = _later(chunk)
            for part, by in ((~late, chunk["one"]), (late, mix(chunk["rid"].view(np.uint64)))):
                if part.any():
                    own = {name: x[part] for name, x in chunk.items()} | {"late": late[part]}
                    yield from deal(shard_of(by[part], shards), shards, own)

    return run


def _later(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Which windows have an equal one with a smaller document."""
    one, two, doc = columns["one"], columns["two"], columns["doc"]
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = doc > least
    return later


def _judge(columns: dict[str, np.ndarray]):
    asked = np.flatnonzero(~columns["late"])
    late = columns["late"].copy()
    late[asked] = _later({name: x[asked] for name, x in columns.items()})
    return columns["rid"][late], columns["place"][late]


def identified(documents: DataFrame, *columns) -> DataFrame:
    """doc (id, null last), text, rid (a hash of the row's id and text, the same for repeated rows)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return documents.select(doc.alias("doc"), "text", F.xxhash64(doc, "text").alias("rid"), *columns)


def repeated_windows(texts: DataFrame, window: int = 13) -> DataFrame:
    """(rid, places): first words of the windows of each row that also start in a smaller document."""
    gram = min(GRAM, window)
    suspects = repeated_keys(texts, _gram_keys(window, gram), KEYS_PER_CHAR, by_row=True)
    shards = shards_for(texts, WINDOWS_PER_CHAR)
    packed = texts.join(suspects, "rid").mapInArrow(_send_windows(window, gram, shards), PACKED)
    return resolve(packed, shards, _judge, "places")


def _kept_words(part, window: int):
    places = part.column("places").to_pylist()
    for text, own in zip(part.column("text").to_pylist(), places):
        words = (text or "").encode().split()
        if own:
            gone = runs(np.array(own), window, len(words))
            yield len(words), int(gone.sum()), list(compress(words, ~gone))
        else:
            yield len(words), 0, words


def _digest(window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()) for n, gone, kept in _kept_words(part, window)]
                n, gone, digest = zip(*rows)
                doc = part.column("doc")
                doc = pa.array(doc.to_numpy(), mask=doc.to_numpy() == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def substring_dedup(documents: DataFrame, window: int = 13) -> DataFrame:
    """Per document: its words, those removed, and the checksum of the kept words joined by spaces."""
    texts = identified(documents)
    marked = texts.join(repeated_windows(texts, window), "rid", "left").select("doc", "text", "places")
    return marked.mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewrite(window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [
                    b" ".join(kept).decode() if gone else old
                    for (_, gone, kept), old in zip(_kept_words(part, window), part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column("row")], ["text", "row"])

    return run


def remove_repeats(documents: DataFrame, window: int = 13) -> DataFrame:
    """``documents`` with repeated windows cut from the texts; texts without any stay as they are."""
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row")
    texts = identified(documents, rest)
    marked = texts.join(repeated_windows(texts.drop("row"), window), "rid", "left").select("text", "row", "places")
    out = marked.select("text", "row")
    cut = marked.mapInArrow(_rewrite(window), out.schema)
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
