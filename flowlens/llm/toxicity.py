"""Toxicity by a classifier chain over hashed words.

The categories are label columns, taken in a stated order. Each gets a linear (logistic)
model over the presence of words and word beginnings; a later model also sees the log-odds of the earlier
categories. While training, those log-odds come from models that did not see the row (out of
fold), so later models learn how far earlier predictions can be trusted; models for scoring are
then fitted on all training rows.

Training takes a bounded sample of labelled documents (``sample_rows``, chosen by a hash of the
id) in one task; the model is at most ``features`` of them for each category. Scoring covers every
word of every document, in the scan's own tasks.

Null texts are empty; they get the models' bias. Labels that are null or of unknown documents
are not used; of repeated labels for a document the largest counts; repeated documents each
give their row. Without any labels, or with one class alone, a category's probability is its
rate in training (0 without rows).
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.wordscan import Splitter, slices

FOLDS = 3
STEPS = 120
PENALTY = 1e-4
LEAST_DOCUMENTS = 5
LEAST_SCORE = 20.0
PREFIX_BYTES = 5
BALANCE = 0.5
# (row, word) pairs that training adds up at a time.
PAIRS = 1 << 21


@dataclass
class Linear:
    """Logistic regression on word presence and a few dense columns."""

    words: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def log_odds(self, row: np.ndarray, word: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
        """``row``, ``word``: the distinct (row, word) pairs of the texts."""
        total = np.full(rows, self.bias) + dense @ self.dense
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            total += np.bincount(row[hit], weights=self.weights[at[hit]], minlength=rows)
        return total


def _sums(at: np.ndarray, size: int, values=None, of=None) -> np.ndarray:
    """Sums of ``values[of]`` (of ones without them) by number ``at``."""
    total = np.zeros(size)
    for first in range(0, len(at), PAIRS):
        part = slice(first, first + PAIRS)
        total += np.bincount(at[part], weights=None if values is None else values[of[part]], minlength=size)
    return total


def _select(row, word, target, features: int) -> np.ndarray:
    """Numbers of the words that tell the classes apart best (chi-square over documents that hold them)."""
    size, p = int(word.max(initial=-1)) + 1, target.mean()
    n, hit = _sums(word, size), _sums(word, size, target, row)
    with np.errstate(invalid="ignore"):  # words of other folds only
        score = (hit - n * p) ** 2 / (n * p * (1 - p))
    score[(n < LEAST_DOCUMENTS) | ~(score >= LEAST_SCORE)] = 0
    best = np.lexsort((np.arange(size), -score))[:features]
    return np.sort(best[score[best] > 0])


def fit_linear(row, word, target: np.ndarray, dense: np.ndarray, features: int) -> Linear:
    """Model of the distinct (row, word number) pairs."""
    rows = len(target)
    p = target.mean() if rows else 0.0
    if p in (0.0, 1.0):
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), 20.0 if p else -20.0)
    words = _select(row, word, target, features)
    place = np.full(int(word.max(initial=-1)) + 1, -1, np.int32)
    place[words] = np.arange(len(words))
    hit = place[word] >= 0
    row, at = row[hit], place[word[hit]]
    held, told = _sums(at, len(words)), _sums(at, len(words), target, row)
    weights = np.log((told + 0.5) / (held - told + 0.5) * (1 - p) / p)  # start at the words' own log-odds
    share = np.where(target > 0, ((1 - p) / p) ** BALANCE, 1.0)  # the rarer class counts more
    share /= share.sum()
    extra, bias = np.zeros(dense.shape[1]), (1 - BALANCE) * float(np.log(p / (1 - p)))
    seen = [np.full(len(words), 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
    for _ in range(STEPS):
        odds = bias + _sums(row, rows, weights, at) + dense @ extra
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target) * share
        slopes = [_sums(at, len(words), error, row) + PENALTY * weights, dense.T @ error + PENALTY * extra, error.sum()]
        seen = [s + g * g for s, g in zip(seen, slopes)]
        weights, extra, bias = (v - 0.3 * g / np.sqrt(s) for v, g, s in zip((weights, extra, bias), slopes, seen))
    return Linear(words, weights, extra, float(bias))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def log_odds(self, row, word, rows: int) -> np.ndarray:
        """One column for each category, each from the words and the columns before it."""
        odds = np.zeros((rows, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.log_odds(row, word, rows, odds), -20, 20)])
        return odds


def fit_chain(row, word, targets: np.ndarray, folds: np.ndarray, categories: list[str], features: int, vocabulary=None) -> Chain:
    """``targets``: a column of 0/1 for each category; ``folds``: the fold of each row; ``word``: words, or their
    numbers in a sorted ``vocabulary``."""
    if vocabulary is None:
        vocabulary, word = np.unique(word, return_inverse=True)
    rows, models = len(targets), []
    odds = np.zeros((rows, 0))
    for c in range(len(categories)):
        target, held_out = targets[:, c].astype(float), np.zeros(rows)
        if c < len(categories) - 1:
            for fold in range(FOLDS):
                out = folds == fold
                inside, beyond = (np.cumsum(x).astype(np.int32) - 1 for x in (~out, out))
                part = out[row]
                asked = beyond[row[part]], word[part], int(out.sum()), odds[out]
                part = ~part
                model = fit_linear(inside[row[part]], word[part], target[~out], odds[~out], features)
                held_out[out] = model.log_odds(*asked)
        models.append(fit_linear(row, word, target, odds, features))
        odds = np.column_stack([odds, np.clip(held_out, -20, 20)])
    return Chain(list(categories), [Linear(vocabulary[m.words], m.weights, m.dense, m.bias) for m in models])


def _word_pairs(texts: pa.Array, splitter: Splitter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature hash) pairs in the order of rows: words, and the first bytes of longer words."""
    words = splitter.words(texts)
    long = np.flatnonzero(words.end - words.start > PREFIX_BYTES)
    start = words.start[long]
    prefix = splitter.hasher.ranges(splitter.hasher.sums(words.data), start, start + PREFIX_BYTES) ^ np.uint64(PREFIX_BYTES)
    row, word = np.concatenate([words.row, words.row[long]]), np.concatenate([words.hash, prefix])
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    return row[new], word[new]


def _distinct_words(batches):
    splitter = Splitter("letters", lower=True)
    for batch in batches:
        for part in slices(batch, "text"):
            row, word = _word_pairs(part.column("text"), splitter)
            offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [word[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            others = [part.column(c) for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *others], ["words", *part.schema.names[1:]])


def _fit(categories: list[str], features: int):
    def run(frames):
        words, sizes, targets, folds = [], [], [], []
        for frame in frames:
            words.append(np.frombuffer(b"".join(frame["words"]), np.uint64))
            sizes.append(frame["words"].str.len().to_numpy(np.int64) // 8)
            targets.append(frame[[f"target{i}" for i in range(len(categories))]].to_numpy())
            folds.append(frame["fold"].to_numpy())
        vocabulary = np.zeros(0, np.uint64)
        for part in words:
            vocabulary = np.union1d(vocabulary, part)
        for i, part in enumerate(words):  # each part makes room for its numbers, half as many bytes
            words[i] = np.searchsorted(vocabulary, part).astype(np.int32)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        word = np.concatenate(words) if words else np.zeros(0, np.int32)
        words.clear()
        targets = np.concatenate(targets) if targets else np.zeros((0, len(categories)))
        folds = np.concatenate(folds) if folds else np.zeros(0, np.int64)
        chain = fit_chain(row, word, targets, folds, categories, features, vocabulary)
        import pandas as pd

        yield pd.DataFrame({"model": [pickle.dumps([(m.words, m.weights, m.dense, m.bias) for m in chain.models])]})

    return run


def train_chain(
    documents: DataFrame, labels: DataFrame, categories=("quality", "toxic"), sample_rows: int = 20_000, features: int = 4_096
) -> Chain:
    """Fits the chain on at most ``sample_rows`` labelled documents, chosen by a hash of their ids."""
    known = labels.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *categories]))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max((F.col(f"`{c}`") > 0).cast("double")).alias(f"target{i}") for i, c in enumerate(categories)]
    )
    place = F.xxhash64("doc_id", F.lit(17))
    share = min(1.0, 1.2 * sample_rows / max(known.count(), 1))
    chosen = known.where(place < F.lit(int((2 * share - 1) * (2**63 - 1)))) if share < 1 else known
    chosen = chosen.orderBy(place).limit(sample_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS)))
    texts = documents.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", *[c for c in chosen.columns if c != "doc_id"])
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "text"]
    packed = rows.mapInArrow(_distinct_words, ", ".join(["words binary", *[f"`{n}` {t}" for n, t in kinds]]))
    one = packed.groupBy(*[n for n, _ in kinds]).agg(F.min("words").alias("words"))  # of several texts of an id, the same each time
    fitted = one.coalesce(1).sortWithinPartitions("doc_id")
    models = fitted.mapInPandas(_fit(list(categories), features), "model binary").first().model
    return Chain(list(categories), [Linear(*m) for m in pickle.loads(models)])


def _score(chain: Chain):
    def run(batches):
        splitter = Splitter("letters", lower=True)
        for batch in batches:
            for part in slices(batch, "text"):
                row, word = _word_pairs(part.column("text"), splitter)
                odds = chain.log_odds(row, word, part.num_rows)
                scores = [pa.array(1 / (1 + np.exp(-odds[:, i]))) for i in range(odds.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *scores], [*part.schema.names, *[f"p_{c}" for c in chain.categories]]
                )

    return run


def score_toxicity(documents: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """Per document the probability of each category of the chain, and whether the last reaches ``threshold``."""
    kinds = ", ".join(f"`p_{c}` double" for c in chain.categories)
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(chain), f"doc_id long, text string, {kinds}"
    )
    return scored.drop("text").withColumn("rejected", F.col(f"`p_{chain.categories[-1]}`") >= threshold)


def drop_toxic(documents: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``documents`` without those the chain rejects; columns unchanged."""
    rest = [c for c in documents.columns if c != "text"]
    packed = documents.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = T.StructType([*packed.schema.fields, *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories]])
    kept = packed.mapInArrow(_score(chain), schema).where(F.col(f"`p_{chain.categories[-1]}`") < threshold)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
