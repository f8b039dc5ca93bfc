"""Fill-in-middle rearrangement of texts, assembled by a secondary sort.

A text is cut into units (runs of ASCII letters, or one other code point) and at two places
drawn from its id into prefix, middle and suffix. Tasks do not build the rearranged text: they emit
pieces of at most ``CHUNK_UNITS`` units, keyed by the document's row and the piece's position in the output.
One shuffle brings a row's pieces together, sorted by position, and they stream into a digest.
The same stream is read back: marks are found across piece borders, every stretch gets its
place in the original, and a second sort inside the same partitions (no shuffle) streams the
restored text into a second digest.

A partition holds whole rows but a task never holds a whole text, unless ``keep_text`` asks for the
output texts; the sorts spill. Keys are rows, so any number of rows with one id spread evenly.
The row key is its place in the input partition: an input whose rows come in another order when
a task is repeated should be stored first. Texts that hold one of the marks stay plain, so marks
are unambiguous. Null texts are empty and plain; a null id draws as an empty string would. Repeated
rows and ids each give their row; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.wordscan import slices, utf8

#: The marks before prefix, suffix and middle, and their order in each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PLAIN_FROM, SPM_BELOW = 90, 20
CHUNK_UNITS = 8192
HEAD = -1
PART = 1 << 40
ABOUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"row long, place long, data binary, {ABOUT}, output_sha256 string, output string"
RESULT = f"{ABOUT}, output_sha256 string, restored_sha256 string, output string"
FIELDS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output")


def draws(documents: DataFrame, seed: int = 1) -> DataFrame:
    """Ids, texts and the four numbers that an id draws."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    return rows.select("doc_id", "text", *numbers)


class Units:
    """Where the units of a slice's texts start, and the code points before each byte."""

    def __init__(self, texts: pa.Array):
        self.data, self.rows = utf8(texts)
        letter = ((self.data | 0x20) >= 0x61) & ((self.data | 0x20) <= 0x7A)
        whole = (self.data & 0xC0) != 0x80
        follows = np.zeros(len(self.data), bool)
        follows[1:] = letter[1:] & letter[:-1]
        follows[self.rows[:-1][self.rows[:-1] < len(self.data)]] = False
        self.starts = np.append(np.flatnonzero(whole & ~follows), len(self.data))
        self.first = np.searchsorted(self.starts[:-1], self.rows)
        self.points = np.append(0, np.cumsum(whole))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def at(self, row: int, unit: int) -> int:
        """The byte at which a row's unit starts; its end if there is no such unit."""
        return int(self.starts[self.first[row] + unit])

    def chunks(self, row: int, low: int, high: int, size: int):
        """Bytes of units ``low`` to ``high`` of a row, ``size`` units at a time."""
        for unit in range(low, high, size):
            yield self.data[self.at(row, unit) : self.at(row, min(unit + size, high))].tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _cut(size: int):
    """Pieces of every row in the order of the output, and a head that describes the row."""
    schema = _schema(PIECES)

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                units, counts = Units(texts), None
                counts = units.counts()
                h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                a, b = np.minimum(h1 % (counts + 1), h2 % (counts + 1)), np.maximum(h1 % (counts + 1), h2 % (counts + 1))
                plain = (counts == 0) | (h3 % 100 >= PLAIN_FROM)
                for mark in PLACES:
                    plain |= pc.match_substring(texts, mark.decode()).to_numpy(zero_copy_only=False)
                out = []
                for r, doc in enumerate(part.column("doc_id").to_pylist()):
                    n, low, high = int(counts[r]), int(a[r]), int(b[r])
                    form = "plain" if plain[r] else "spm" if h4[r] % 100 < SPM_BELOW else "psm"
                    stretches = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
                    size_of = {m: int(units.points[units.at(r, y)] - units.points[units.at(r, x)]) for m, (x, y) in stretches.items()}
                    about = (doc, n, form, *((None, None) if plain[r] else (size_of[PREFIX], size_of[MIDDLE])), None, None)
                    out.append((row, HEAD, None, *about))
                    place = 0
                    for mark in (b"",) if plain[r] else ORDERS[form]:
                        begun = False
                        for data in units.chunks(r, *(stretches[mark] if mark else (0, n)), size):
                            out.append((row, place, data if begun else mark + data, *[None] * 7))
                            place, begun = place + 1, True
                        if mark and not begun:
                            out.append((row, place, mark, *[None] * 7))
                            place += 1
                    row += 1
                yield _batch(out, schema)

    return run


class Reader:
    """Reads one row's output piece by piece and says where each stretch belongs in the original."""

    def __init__(self, form: str):
        self.ahead = list(ORDERS.get(form, ()))
        self.place, self.held = 0, b""

    def feed(self, data: bytes):
        """(place in the original, stretch) of all that is sure so far."""
        data = self.held + data
        while self.ahead:
            mark = self.ahead[0]
            at = data.find(mark)
            if at < 0:
                # the mark may have begun: keep what could be its first bytes
                keep = next((k for k in (2, 1) if data.endswith(mark[:k])), 0)
                yield from self._give(data[: len(data) - keep])
                self.held = data[len(data) - keep :]
                return
            yield from self._give(data[:at])
            data, self.ahead, self.place = data[at + len(mark) :], self.ahead[1:], PLACES[mark] * PART
        self.held = b""
        yield from self._give(data)

    def _give(self, data: bytes):
        if data:
            yield self.place, data
            self.place += 1


def _assemble(keep_text: bool):
    """Digests of the outputs, and their stretches keyed by place in the original."""
    schema = _schema(PIECES)

    def run(batches):
        row, head, digest, reader, texts, out = None, None, None, None, [], []

        def close():
            if head is not None:
                text = b"".join(texts).decode() if keep_text else None
                out.append((row, HEAD, None, *head[:5], digest.hexdigest(), text))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "place", "data")]
            about = [batch.column(c) for c in FIELDS[:5]]
            for k, (key, place, data) in enumerate(zip(*columns)):
                if place == HEAD:
                    close()
                    row, head = key, tuple(c[k].as_py() for c in about)
                    digest, reader, texts = hashlib.sha256(), Reader(head[2]), []
                    continue
                digest.update(data)
                if keep_text:
                    texts.append(data)
                out += [(row, p, x, *[None] * 7) for p, x in reader.feed(data)]
            if out:
                yield _batch(out, schema)
                out.clear()
        close()
        if out:
            yield _batch(out, schema)

    return run


def _restore(batches):
    """One row for each document, with the digest of the text that its sorted stretches make."""
    schema = _schema(RESULT)
    head, digest, out = None, None, []

    def close():
        if head is not None:
            *about, output_sha, output = head
            out.append((*about, output_sha, digest.hexdigest(), output))

    for batch in batches:
        about = [batch.column(c) for c in FIELDS]
        for k, (place, data) in enumerate(zip(batch.column("place").to_pylist(), batch.column("data").to_pylist())):
            if place == HEAD:
                close()
                head, digest = tuple(c[k].as_py() for c in about), hashlib.sha256()
            else:
                digest.update(data)
        if out:
            yield _batch(out, schema)
            out.clear()
    close()
    if out:
        yield _batch(out, schema)


def pieces(documents: DataFrame, seed: int = 1, chunk_units: int = CHUNK_UNITS) -> DataFrame:
    """The outputs' pieces: the data of one row in order of ``place`` is its output (a head at -1 describes it)."""
    return draws(documents, seed).mapInArrow(_cut(chunk_units), PIECES)


def infill(documents: DataFrame, seed: int = 1, chunk_units: int = CHUNK_UNITS, keep_text: bool = False) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, digests of the output and of the text
    restored from it (and the output itself, with ``keep_text``)."""
    dealt = pieces(documents, seed, chunk_units).repartition("row").sortWithinPartitions("row", "place")
    restored = dealt.mapInArrow(_assemble(keep_text), PIECES).sortWithinPartitions("row", "place").mapInArrow(_restore, RESULT)
    return restored if keep_text else restored.drop("output")
