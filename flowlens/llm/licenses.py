"""Licence scan with a positional index of rare tokens.

Templates are short word sequences. The rarest words of every template, by inverse document
frequency over all documents, are indexed with their positions. All indexed words of a document
vote for (template, place) pairs through those postings; the places
where all rare words of a phrase agree are compared word by word, and a template's label is
given where its mandatory phrase stands and enough of its weight is found in place.

Null texts are empty: no words, no labels, score 0. Repeated rows each give their row.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.wordscan import Splitter, slices

#: The phrases whose places are counted, and their labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Opening words of public licence notices with the phrase that must stand whole.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with"
        " the license",
        "apache license version 2",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        "gnu general public license",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted",
        "permission to use copy modify and or distribute this software",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution", "creative commons attribution"),
}

RARE_WORDS = 6
LEAST_SCORE = 0.5
PLACES = 1 << 12


@dataclass
class Phrase:
    label: str
    words: list[str]
    required: list[str]
    base: bool


def phrases() -> list[Phrase]:
    base = [Phrase(label, text.split(), text.split(), True) for label, text in BASE.items()]
    return base + [Phrase(label, text.split(), key.split(), False) for label, (text, key) in TEMPLATES.items()]


def word_hashes(words: list[str]) -> np.ndarray:
    return Splitter("letters").words(pa.array([" ".join(words)])).hash


def _vocabulary_counts(vocabulary: list[str]):
    order = np.argsort(word_hashes(vocabulary))
    known = word_hashes(vocabulary)[order]
    names = [vocabulary[i] for i in order]

    def run(batches):
        splitter, counts, rows = Splitter("letters", lower=True), np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.words(part.column("text"))
                rows += part.num_rows
                at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                hit = known[at] == words.hash
                pairs = np.unique(words.row[hit] * len(known) + at[hit])
                counts += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*counts, rows], pa.int64())], ["word", "df"])

    return run


def inverse_frequency(documents: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of every word of the vocabulary over all documents."""
    counted = documents.select("text").mapInArrow(_vocabulary_counts(vocabulary), "word string, df long")
    df = {r.word: r.df for r in counted.groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n = df.pop("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


class Index:
    """Postings of the rare words: word hash to (phrase, position)."""

    def __init__(self, phrases: list[Phrase], idf: dict[str, float]):
        self.phrases = phrases
        self.weights = [np.array([idf[w] for w in p.words]) for p in phrases]
        self.hashes = [word_hashes(p.words) for p in phrases]
        self.required = [word_hashes(p.required) for p in phrases]
        self.idf, postings = {}, {}
        for number, p in enumerate(phrases):
            rare = sorted(set(p.words), key=lambda w: (-idf[w], w))[:RARE_WORDS]
            for position, word in enumerate(p.words):
                if word in rare:
                    h = int(self.hashes[number][position])
                    postings.setdefault(h, []).append((number, position))
                    self.idf[h] = idf[word]
        self.votes = {h: own for h, x in postings.items() if (own := [(n, i) for n, i in x if not phrases[n].base])}
        self.words = np.array(sorted(self.idf), np.uint64)
        self.best = [max(range(len(p.words)), key=lambda i: (idf[p.words[i]], -i)) for p in phrases]

    def places(self, words, number: int, sequence: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """First words of all places where a sequence that holds the phrase's rarest word stands whole."""
        anchor = self.hashes[number][self.best[number]]
        offset = int(np.flatnonzero(sequence == anchor)[0])
        start = hits[words.hash[hits] == anchor] - offset
        start = start[(start >= 0) & (start + len(sequence) <= len(words.hash))]
        for j, h in enumerate(sequence):
            start = start[words.hash[start + j] == h]
        return start[words.row[start] == words.row[start + len(sequence) - 1]]

    def align(self, words, r: int, at: np.ndarray) -> dict[int, float]:
        """Per template the largest share of its weight that stands in place, from all of a row's licence words."""
        places = {}
        for i, h in zip(at.tolist(), words.hash[at].tolist()):
            for n, p in self.votes.get(h, ()):
                places.setdefault(n, set()).add(i - p)
        best, first, last = {}, words.first[r], words.first[r + 1]
        for number, starts in places.items():
            starts, weights = np.fromiter(starts, np.int64, len(starts)), self.weights[number]
            for a in range(0, len(starts), PLACES):
                span = starts[a : a + PLACES, None] + np.arange(len(weights))
                inside = (span >= first) & (span < last)
                same = inside & (words.hash[np.where(inside, span, first)] == self.hashes[number])
                found = same @ weights
                for own in np.unique(same[found > found.max() - 1e-9], axis=0):
                    best[number] = max(best.get(number, 0.0), float(weights[own].sum() / weights.sum()))
        return best


def _scan(idf: dict[str, float]):
    def run(batches):
        index, splitter = Index(phrases(), idf), Splitter("letters", lower=True)
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.words(part.column("text"))
                spot = np.minimum(np.searchsorted(index.words, words.hash), len(index.words) - 1)
                hits = np.flatnonzero(index.words[spot] == words.hash)
                rows = part.num_rows
                base, labels, score = [set() for _ in range(rows)], [set() for _ in range(rows)], np.zeros(rows)
                n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                for number, p in enumerate(index.phrases):
                    if not p.base:
                        continue
                    at = index.places(words, number, index.hashes[number], hits)
                    at = np.array([i for i in at if all(words.text(i + j) == w.encode() for j, w in enumerate(p.words))], np.int64)
                    row = words.row[at]
                    n_base += np.bincount(row, minlength=rows)
                    np.minimum.at(first, row, at - words.first[row])
                    np.maximum.at(last, row, at - words.first[row])
                    for r in set(row.tolist()):
                        base[r].add(p.label), labels[r].add(p.label)
                        score[r] = 1.0
                bounds = np.searchsorted(hits, words.first)
                for r in np.flatnonzero(np.diff(bounds)):
                    own = hits[bounds[r] : bounds[r + 1]]
                    for number, share in index.align(words, r, own).items():
                        key = index.required[number]
                        own_all = np.arange(words.first[r], words.first[r + 1] - len(key) + 1)
                        for j, h in enumerate(key):
                            own_all = own_all[words.hash[own_all + j] == h] if share >= LEAST_SCORE else own_all[:0]
                        if len(own_all):
                            labels[r].add(index.phrases[number].label)
                            score[r] = max(score[r], share)
                found = n_base > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.count(), pa.int64()), pa.array(n_base),
                     pa.array(first, mask=~found), pa.array(last, pa.int64(), mask=~found),
                     pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]),
                     pa.array(np.minimum(score, 1.0))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, base labels, all labels and the best template's share of weight."""
    idf = inverse_frequency(documents, sorted({w for p in phrases() for w in [*p.words, *p.required]}))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(idf),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
