import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.wordscan import Splitter, mix, runs, slices
from tests.llm.brute import LETTERS, PLAIN, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\t\n\x00-\x7fß中", max_size=30)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for kind, low, pattern in (("plain", False, PLAIN), ("plain", True, PLAIN), ("letters", True, LETTERS)):
        words = Splitter(kind, low).words(pa.array(texts, pa.string()))
        for r, text in enumerate(texts):
            raw = lower(text) if low else (text or "").encode()
            assert [words.text(i) for i in range(words.first[r], words.first[r + 1])] == pattern.findall(raw)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    words = Splitter("plain").words(pa.array(["ab cd ab", "x ab", "abcd cd"]))
    by = {}
    for i, h in enumerate(words.hash):
        by.setdefault(words.text(i), set()).add(int(h))
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_windows_stay_within_rows():
    words = Splitter("plain").words(pa.array(["a b c", None, "", "a b", "a b c d"]))
    assert words.starts(3).tolist() == [0, 5, 6]
    grams = words.grams(3)[words.starts(3)]
    assert grams[0] == grams[1] != grams[2]


def test_slices_cover_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * random.randint(0, 50) for _ in range(200)] + [None, "y" * 500]})
    parts = list(slices(batch, "text", 100))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_runs_and_mix():
    assert runs(np.array([1, 2, 6]), 2, 8).tolist() == [False, True, True, True, False, False, True, True]
    assert len(np.unique(mix(np.arange(1000, dtype=np.uint64)))) == 1000
