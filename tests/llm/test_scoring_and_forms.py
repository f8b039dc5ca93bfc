"""Lattice likelihood, fill-in-middle and whitening against plain versions, on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import infilling, likelihood, whitening
from flowlens.llm.queries import piece_model

DOCS = "doc_id long, text string, row long, place string, h1 string, held_out string, digest string, score string"
TEXTS = [
    None, "", " ", "a", "Ab cd", "  Ab   cd\n\te ", "x <P> y", "<S>", "<", "<P", "one <M", "ünï çödé", "日本 語", "▁ a▁b", "\x00\x07",
    "a b", "no no no", "it's 10% <b>", "z" * 300, "-" * 60, "q\U0001f600q", "<<<S<P<M<", "P>S>M>",
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "y", "z", "w", "d", "s") for r in rows], DOCS).repartition(3)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "run", "runs", "ünder", "x1", "<P", "end.", "日本", "kitten", "sitting"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(7, "again"), (7, "again"), (3, rows[3][1]), (None, "nobody's text"), (None, None), (-5, "minus")]
    return rows


# --- fill-in-middle ---


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), out, text


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("chunk_units", [1, 2, 7, 8192])
def test_infill(spark, chunk_units):
    rows = corpus() + [(77, "word " * 20_000), (78, "é" * 9000)]
    got = infilling.infill(frame(spark, rows), chunk_units=chunk_units, keep_text=True).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*w[:5], sha(w[5]), sha(w[6]), w[5]) for w in (plain_infill(*r) for r in rows)]
    assert ordered(tuple(r) for r in got) == ordered(want)


def test_infill_of_one_id_spreads_over_partitions(spark):
    docs = frame(spark, [(7, f"text number {i}") for i in range(400)])
    dealt = infilling.pieces(docs).repartition(8, "row")
    sizes = [r[0] for r in dealt.where("place = -1").groupBy(infilling.F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 400 and max(sizes) < 100


def test_reader_finds_marks_across_pieces():
    text = b"<P>ab<<S>c<M<M>d<P"
    for size in range(1, 6):
        reader, out = infilling.Reader("psm"), []
        for i in range(0, len(text), size):
            out += reader.feed(text[i : i + size])
        assert b"".join(x for _, x in sorted(out)) == b"ab<d<Pc<M"


def test_infill_of_nothing(spark):
    assert infilling.infill(spark.createDataFrame([], DOCS)).collect() == []


# --- lattice likelihood ---


def segmentations(model, chunk):
    if not chunk:
        yield []
    for e in range(1, len(chunk) + 1):
        if chunk[:e] in model.pieces:
            first = [model.pieces[chunk[:e]]]
        elif e == 1:
            first = model.spell(chunk[0])
        else:
            continue
        for rest in segmentations(model, chunk[e:]):
            yield first + rest


def plain_scores(rows, rounds):
    """All columns by counting and by listing every segmentation of every chunk."""
    model = likelihood.Model(piece_model())
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    c = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    lists = {}

    def paths(chunk):
        if chunk not in lists:
            lists[chunk] = [Counter(s) for s in segmentations(model, chunk)]
        return lists[chunk]

    chunks = [re.findall("\u2581*[^\u2581]+|\u2581+", model.processor.normalize(t or "")) for _, t in rows]
    prior = weights = likelihood.first_weights(model)
    probability = lambda s, w: math.prod(w[i] ** k for i, k in s.items())
    for _ in range(rounds):
        counts = np.zeros(len(prior))
        counts[-1] = c[None]
        for (i, _), own in zip(rows, chunks):
            for chunk in own if not held[i] else ():
                all_ = [probability(s, weights) for s in paths(chunk)]
                for s, p in zip(paths(chunk), all_):
                    for piece, k in s.items():
                        counts[piece] += k * p / sum(all_)
        weights = (counts + likelihood.PRIOR * prior) / (counts.sum() + likelihood.PRIOR)
    out = []
    for (i, t), own in zip(rows, chunks):
        score = sum(math.log10(sum(probability(s, weights) for s in paths(x))) for x in own) + math.log10(weights[-1])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        out.append((i, held[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base, score))
    return out


def close(got, want):
    key = lambda r: (str(r[:5]), round(r[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("rounds, frequent", [(1, 200_000), (2, 20), (0, 1)])
def test_likelihood(spark, monkeypatch, rounds, frequent):
    monkeypatch.setattr(likelihood, "FREQUENT", frequent)
    rows = [r for r in corpus() if len(r[1] or "") < 200 or " " in r[1]]
    rows = [(i, t) for i, t in rows if t not in ("-" * 60, "z" * 300)]
    close(likelihood.score_texts(frame(spark, rows), piece_model(), rounds).collect(), plain_scores(rows, rounds))


def test_long_chunks_equal_short_ones(monkeypatch):
    model = likelihood.Model(piece_model())
    lattice = likelihood.Lattice(model, likelihood.first_weights(model))
    chunk = "▁unbreakable日\u0007本xyzzy"
    short, total = lattice.forward([chunk], len(chunk))[0][0, -1], np.zeros(len(lattice.logs))
    lattice.expect([chunk], len(chunk), np.array([3.0]), total)
    monkeypatch.setattr(likelihood, "BATCH_CHARS", 4)
    other = np.zeros(len(lattice.logs))
    assert math.isclose(lattice.forward([chunk], len(chunk))[0][0, -1], short, rel_tol=1e-12)
    lattice.expect([chunk], len(chunk), np.array([3.0]), other)
    np.testing.assert_allclose(other, total, rtol=1e-9)
    monkeypatch.undo()
    assert np.isfinite(lattice.forward(["ab" * 10_000], 20_000)[0][0, -1])


def test_lattice_probabilities_of_all_texts_stay_below_one():
    """Texts of one chunk are different outcomes of one draw, so they share at most all probability."""
    model = likelihood.Model(piece_model())
    scorer = likelihood.Scorer(model, likelihood.first_weights(model))
    texts = sorted({t for x in model.pieces if (t := x.replace("▁", " ").strip()) and " " not in t})
    assert 0 < np.exp(scorer(pa.array(texts))).sum() < 1


def test_training_raises_held_out_likelihood(spark):
    rows = corpus(n=400)
    docs = frame(spark, rows)
    total = [
        sum(r.score for r in likelihood.score_texts(docs, piece_model(), rounds).where("held_out").collect()) for rounds in (0, 1, 2)
    ]
    assert total[0] < total[1] < total[2]


def test_likelihood_without_training_texts_or_rows(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = likelihood.score_texts(frame(spark, [(held, "all held out")]), piece_model()).collect()
    assert [tuple(r)[:6] for r in got] == [(held, True, 4, 0, 0, 0.0)] and got[0].score < 0
    assert likelihood.score_texts(spark.createDataFrame([], DOCS), piece_model()).collect() == []


def test_equal_first_halves_of_frequent_hashes_are_told_apart():
    words = likelihood.FrequentWords(np.array([5, 9], np.uint64), np.array([1, 2], np.uint64), np.array([10, 20]))
    assert words.count(np.array([5, 5, 9, 7], np.uint64), np.array([1, 2, 2, 1], np.uint64)).tolist() == [10, -1, 20, -1]


# --- whitening ---

VECTORS = "vec_id long, embedding array<float>, n long, i string, e string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(3)


def plain_whitening(rows):
    kept = [(i, e) for i, e in rows if e is not None and e and all(c is not None and math.isfinite(c) for c in e)]
    size = max((len(e) for _, e in kept), default=0)
    kept = [(i, e) for i, e in kept if len(e) == size]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in e] for _, e in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(r, sums)] for r in x]
    cov = np.array([[sum(a * b for a, b in zip(p, q)) / n**3 for q in zip(*d)] for p in zip(*d)])
    return [i for i, _ in kept], n, d, cov


def check_whitening(spark, rows, wide=False):
    ids, n, d, cov = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    size = min(8, len(cov))
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == sorted(
        (i, k + 1, n, sum(c * c for c in r) if sum(c * c for c in r) < 1 << 63 else None) for i, r in zip(ids, d) for k in range(size)
    )
    values = np.linalg.eigvalsh(cov)[::-1][:size]
    table = {}
    for r in got:
        table.setdefault(r.component, []).append(r.whitened)
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
        assert r.identity_error < 1e-6
    w = np.array([table[k + 1] for k in range(size)])
    np.testing.assert_allclose(w @ w.T / n, np.eye(size), atol=1e-6)
    return got


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ mix).tolist()) for i in range(300)]
    odd = [(900, None), (901, [None] + [1.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0])]
    rows += [(5, rows[5][1]), (5, rows[6][1])]
    got = check_whitening(spark, rows + odd)
    ids, n, d, cov = plain_whitening(rows)
    values, axes = np.linalg.eigh(cov)
    for r in got:
        if r.vec_id == 17:
            axis = axes[:, -r.component]
            want = np.array(d[17], float) / n @ axis / math.sqrt(values[-r.component])
            assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-8)


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, (rng.normal(size=3) * 1e12).tolist()) for i in range(60)])


def test_sums_of_squares_by_limbs_are_exact():
    rng = np.random.default_rng(5)
    d = rng.integers(-(1 << 52), 1 << 52, (1024, 5))
    assert whitening.squares(d).tolist() == [sum(int(v) ** 2 for v in c) for c in d.T]
    d[:] = (1 << 52) - 1
    assert whitening.squares(d).tolist() == [1024 * ((1 << 52) - 1) ** 2] * 5


def test_covariances_come_from_squares_of_pair_sums():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3000, (50, 4))
    fit = whitening.Fit([SimpleNamespace(i=i, n=50, s=int(x[:, i].sum()), low=0, high=3000) for i in range(4)])
    batch = pa.record_batch({"vec_id": pa.array(range(50)), "e": pa.array(((x - whitening.SHIFT) / 1024).tolist(), pa.list_(pa.float64()))})
    (sums,) = whitening._pair_squares(fit)([batch])
    d = fit.centred(x).astype(object)
    for i, j, *q in zip(*(c.to_pylist() for c in sums.columns)):
        both = d[:, i] if i == j else d[:, i] + d[:, j]
        assert q[0] + (q[1] << 40) + (int(q[2]) << 80) == (both * both).sum()


def test_whitening_of_what_does_not_vary(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)
    ]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in flat)
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
