"""The operators against brute force on small, awkward tables: nulls, ties, repeated rows, long texts, odd columns."""

import random
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import decontaminate, embeddings, html, jaccard, licenses, pieces, substrings, suffixes, tokenfiles, toxicity
from flowlens.llm.components import components
from flowlens.llm.sketch import repeated_keys
from flowlens.llm.wordscan import Splitter, mix
from tests.llm import brute

DOCS = "doc_id long, text string, key long, rid string, shard string, place string"


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, 7, "x", None, "y") for r in rows], DOCS).repartition(3)


def corpus(seed, n=60, words="ab cd ef gh ij".split(), long=True):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        parts = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(words))
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(1, None), (2, ""), (4, " \t"), (5, "ab"), (7, "Ab cD"), (10**12, rows[0][1]), (8, "ÄÖ ab")]
    return rows + ([(10, " ".join(rng.choices(words, k=20_000)))] if long else [])


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (2, 80, 3)])
def test_jaccard(spark, k, percent, seed):
    rows = corpus(seed, long=seed == 1)
    got = {r.doc: (r.n, r.component) for r in jaccard.link_documents(frame(spark, rows), k, percent).collect()}
    assert got == brute.jaccard(rows, k, percent)


def test_jaccard_near_copies_of_two_kinds_meet_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_POINTS", 16)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 600)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    got = {r.doc: (r.n, r.component) for r in jaccard.link_documents(frame(spark, rows), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert 1 < len({c for _, c in got.values()}) < 90


def test_jaccard_of_a_table_united_with_itself(spark):
    rng = random.Random(0)
    texts = []
    for c in range(20):
        base = [f"w{c}x{i}" for i in range(120)]
        for _ in range(16):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    both = frame(spark, rows).union(frame(spark, rows))
    got = {r.doc: (r.n, r.component) for r in jaccard.link_documents(both, 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)


def test_jaccard_of_two_texts_of_one_id(spark):
    one, two = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (1, None), (2, " ".join([*one[:-1], "x"])), (3, " ".join([*two[:-1], "x"]))]
    got = {r.doc: r.component for r in jaccard.link_documents(frame(spark, rows), 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    none, some = np.zeros(0, np.uint64), np.ones(1, np.uint64)
    assert not any(jaccard._same(x, y, 90) for x, y in ((none, none), (none, some), (some, none)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1), st.integers(0, 3))
def test_parities_never_exceed_the_difference(a, b, stretch):
    b = b | {x + 1000 for x in range(150 * stretch)}  # vectors of several lengths
    row = np.repeat([0, 1], [len(a), len(b)])
    one, two = jaccard.parities(row, mix(np.array([*a, *b], np.uint64)), 2)
    assert jaccard.difference_bound(one, two) <= len(a ^ b)
    assert jaccard.difference_bound(one, one) == 0


def test_parities_rule_out_most_unlike_sets():
    hashes = mix(np.arange(2000, dtype=np.uint64))
    row = np.repeat([0, 1, 2], [1000, 1000, 1000])
    sets = np.concatenate([hashes[:1000], hashes[1000:], hashes[100:1100]])
    first, other, near = jaccard.parities(row, sets, 3)
    may = [jaccard.may_link((2000 - jaccard.difference_bound(first, x)) // 2, 1000, 1000, 80) for x in (other, near)]
    assert may == [False, True]  # 900 of 1 100 shingles are shared by the near pair


def test_parities_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(2)
    vectors = [rng.integers(0, 256, 8 << int(w), dtype=np.uint8).tobytes() for w in rng.integers(0, 5, 40)]
    i, j = (x.ravel() for x in np.mgrid[:40, :40])
    want = [jaccard.difference_bound(vectors[a], vectors[b]) for a, b in zip(i, j)]
    assert jaccard.difference_bounds(vectors, i, j).tolist() == want
    assert all(jaccard.difference_bound(jaccard.folded(v, 64), v) == 0 for v in vectors)


def test_texts_that_are_alike_but_not_enough_send_no_pairs(spark):
    """Half of the words in common: the sums of minima let all pairs of the cell through, parities none but the near copies."""
    common = [f"c{i}" for i in range(420)]
    rows = [(d, " ".join([*common, *(f"w{d}x{i}" for i in range(180))])) for d in range(60)]
    rows.append((60, rows[0][1] + " end"))
    texts = frame(spark, rows).withColumnRenamed("doc_id", "doc")
    sets = texts.mapInArrow(jaccard._summaries(5), jaccard.SUMMARY)
    cell = sets.selectExpr("1L as cell", "61L as members", "doc as component", "*")
    assert [(r.a, r.b) for r in jaccard.tree_pairs(cell, 80).collect()] == [(0, 60)]


def test_toxicity_model_is_the_same_whatever_order_texts_of_an_id_come_in(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij kl mn".split(), k=12))) for i in range(60) for _ in range(2)]
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    fitted = []
    for order in (rows, rows[::-1]):
        chain = toxicity.train_chain(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), labels, features=64)
        fitted.append([(m.words.tolist(), m.weights.tolist(), m.bias) for m in chain.models])
    assert fitted[0] == fitted[1]


def test_jaccard_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text, 70, "x", 1), (8, text, 80, "y", 2), (9, "other words", 90, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _place long, doc string, whole int")
    assert sorted(map(tuple, jaccard.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(3, "a b c d"), (3, "x y z"), (1, "x y z"), (2, "a b c d"), (None, "a b c d"), (None, None)]
    got = collected(jaccard.link_documents(frame(spark, rows), 3, 90))
    assert got == ordered([(3, 2, 1), (3, 1, 1), (1, 1, 1), (2, 2, 1), (None, 2, None), (None, 0, None)])
    kept = collected(jaccard.keep_one(frame(spark, rows), 3, 90).select("doc_id", "text"))
    assert kept == ordered([(1, "x y z"), (None, "a b c d"), (None, None)])


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (set(rng.integers(0, 60, rng.integers(1, 40)).tolist()) for _ in range(2))
        p, q = (np.bincount([x % 7 for x in s], minlength=7) for s in (a, b))
        assert jaccard.overlap_bound(p, q) >= len(a & b)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (700, 64)).astype(np.uint32)
    points[350:] = points[:350]
    points[350:, 0] += rng.integers(0, 3, 350).astype(np.uint32)
    sizes, labels = points.sum(1).astype(np.int64), rng.integers(0, 9, 700)
    tree = jaccard.CountTree(points, sizes, labels)
    for i in range(0, 700, 7):
        bound = jaccard.overlap_bound(points[i], points)
        want = np.flatnonzero((labels != labels[i]) & jaccard.may_link(bound, sizes[i], sizes, 90))
        assert sorted(tree.search(points[i], sizes[i], labels[i], 90)) == want.tolist()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = brute.reach(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontaminate(spark, monkeypatch):
    rows = corpus(6)
    items = [(1, rows[0][1]), (22, "ab cd"), (3, "ab"), (4, None), (5, "..."), (None, "gh ij"), (7, rows[3][1] + " zz"), (1, rows[0][1])]
    benchmark = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
    for blocks in (200_000, 20):
        got = decontaminate.find_occurrences(frame(spark, rows), benchmark, 4, blocks)
        assert {r.row.doc_id: set(r["items"]) for r in got.collect() if r["items"]}
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", blocks)
        assert collected(decontaminate.contamination(frame(spark, rows), benchmark, 4)) == ordered(brute.decontaminate(rows, items, 4))
    clean = decontaminate.clean_documents(frame(spark, rows), benchmark, 4)
    assert clean.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in brute.decontaminate(rows, items, 4) if not x[-1]}


@pytest.mark.parametrize("window", [13, 4])
def test_substrings(spark, window):
    rows = corpus(7) + [(0, corpus(7)[0][1]), (None, corpus(7)[5][1]), (None, None)]
    assert collected(substrings.substring_dedup(frame(spark, rows), window)) == ordered(brute.substrings(rows, window))
    cut = substrings.remove_repeats(frame(spark, rows), window)
    want = {i: gone for i, _, gone, _ in brute.substrings(rows, window)}
    for r in cut.where("doc_id is not null").collect():
        old = next(t for i, t in rows if i == r.doc_id)
        assert (r.text == old) or want[r.doc_id]


def test_sketch_loses_no_repeated_key(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(0, 200)))) for i in range(120)]

    def maker():
        splitter = Splitter("plain")

        def extract(column):
            words = splitter.words(column)
            return words.row, words.hash

        return extract

    rows = spark.createDataFrame(texts, "rid long, text string").repartition(5)
    for by_row in (True, False):
        count = {}
        for i, t in texts:
            for w in set(t.split()) if by_row else t.split():
                count[w] = count.get(w, 0) + 1
        splitter = Splitter("plain")
        key = {w: int(splitter.words(pa.array([w])).hash.view(np.int64)[0]) for w in count}
        got = {r.rid: set(r["keys"]) for r in repeated_keys(rows, maker, 0.2, by_row, shard_keys=1000).collect()}
        extra = 0
        for i, t in texts:
            want = {key[w] for w in t.split() if count[w] > 1}
            assert want <= got.get(i, set())
            extra += len(got.get(i, set()) - want)
        assert extra < 200


@pytest.mark.parametrize("length, seed", [(8, 1), (50, 2), (200, 3)])
def test_suffixes(spark, length, seed):
    rows = corpus(seed, n=25, long=False) + [(100, "a" * 600), (101, "ab" * 300), (102, "ab" * 300), (100, "a" * 600), (None, "é" * 300)]
    assert collected(suffixes.suffix_dedup(frame(spark, rows), length)) == ordered(brute.suffixes(rows, length))


def test_grouping_order_sorts_suffixes():
    rng = random.Random(2)
    for _ in range(600):
        x = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffixes.grouping_order(np.array(x, np.int16)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.fixture(scope="module")
def bpe():
    names = pytest.importorskip("public_tokenizers")
    return names.path("byte_bpe_50k.json")


def test_pieces_are_those_of_the_tokenizer(bpe):
    encoder, rng = tokenfiles.Encoder(bpe), random.Random(1)
    bits = ["'s", "'", "'re", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "…", "'ll", " '", "\xa0", "\x1c", "\x85", "<|endoftext|>", "中", "🙂", "​"]
    for _ in range(60):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(20)] + [None, ""]
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, bpe):
    rows = corpus(9) + [(0, "again"), (None, "no id"), (None, None)]
    encoder = tokenfiles.Encoder(bpe)
    manifest = tokenfiles.write_token_files(frame(spark, rows), bpe, 2)
    got = [tuple(r) for r in tokenfiles.digest_token_files(manifest).collect()]
    want = brute.tokens(rows, lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2)
    assert sorted((i is not None, i or 0, n, c) for i, _, n, c in got) == sorted((i is not None, i or 0, n, c) for i, _, n, c in want)
    spans = sorted((s, s + n) for _, s, n, _ in got)
    assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]]
    assert sorted(got, key=lambda r: r[1])[-1][0] == 10**12
    found = tokenfiles.read_tokens(manifest, [0, 5, 12345])
    assert len(found[0]) == 2 and 12345 not in found
    assert found[5][0].tolist() == encoder.tokenizer.encode("ab").ids + [2]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000)).view(np.uint64)
    index = tokenfiles.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert tokenfiles.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PART_VECTORS", 8)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for spread in [0.0, 0.0, *[0.05] * 6, *[0.2] * 4]:
            v = (centre + spread * rng.normal(size=16)).astype(np.float32).tolist()
            rows.append((len(rows) * 2, v, int(rng.integers(0, 2))))
    rows += [(1, None, 0), (3, [], 0), (5, [0.0] * 16, 0), (7, [float("nan")] * 16, 1), (9, rows[0][1], None), (11, [None] * 16, 1), (13, [1.0, 2.0], 0), (15, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "vec_id long, embedding array<float>, label int, group string, cell int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == brute.vectors(rows, 0.98)


PAGES = [
    ("<html><body><nav>Menu, of, links</nav><article><h1>Title</h1><p>First, long enough &amp; fine.<p>Second<br>line &lt;b&gt;</article><footer>&copy; x</footer>", "Title\nFirst, long enough & fine.\nSecond line <b>"),
    ("<body><div class='sidebar'><p>Buy this, and that, and more, please now</p></div><div id=main><p>Real text, with commas, and more words than others here.</p><p>Short.</p></div><div class='comments'><p>I, a reader, say</p></div>", "Real text, with commas, and more words than others here.\nShort."),
    ("<p>One paragraph only.</p><script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>gone</p> -->", "One paragraph only."),
    ("<article><header><h1>Head</h1></header><p>Text</p><form><p>Name, please</p></form><aside>More</aside><ul><li>One<li>Two</ul></article>", "Head\nText\nOne\nTwo"),
    ("just text", "just text"), ("", ""), (None, ""), ("<div></div>", ""), ("<p>a &amp;amp; b &#233; &nosuch; \n\t c</p>", "a &amp; b é &nosuch; c"),
]


def test_html(spark):
    rows = [(i, f"u{i}", page, "x") for i, (page, _) in enumerate(PAGES)] + [(None, None, "<p>" + "w " * 50_000 + "</p>", "x")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert {i: got[i].text for i in range(len(PAGES))} == {i: want for i, (_, want) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[None].n_chars == 99_999


def test_html_keeps_whole_articles():
    line = ("long text here, " * 19).strip()
    long, p = f"<p>{line}</p>" * 20, "\n".join([line] * 20)
    items, cells = [f"item {i}" for i in range(80)], [f"cell {i}" for i in range(300)]
    cases = [
        (f"<article><h1>Head</h1><section><p>One.</p><p>Two.</p></section><section>{long}</section></article>", f"Head\nOne.\nTwo.\n{p}"),
        (f"<article><h1>Head</h1><p>Short.</p><ul>{''.join(f'<li>{x}' for x in items)}</ul></article>", "\n".join(["Head", "Short.", *items])),
        (f"<article><h1>Head</h1><p>Short.</p><table><tr>{''.join(f'<td>{x}' for x in cells)}</table></article>", "\n".join(["Head", "Short.", *cells])),
        (f"<div><h1>Head</h1><div><p>Short.</p></div><div>{long}</div></div>", f"Head\nShort.\n{p}"),
        (f"<main><h1>Head</h1><article><p>Short.</p></article><article>{long}</article></main>", f"Head\nShort.\n{p}"),
        (f"<article><p>Short.</p></article><div><article>{long}</article></div>", f"Short.\n{p}"),
        (f"<article>{long}<article class='comment'><p>I say</p></article></article>", p),
        ("<article><p title='see hidden text'>a</p><p data-x='display: none'>b</p><p data-y=' class=ad'>c</p><p hidden>x</p><p aria-hidden='true'>x</p><p style='color:red; display:none'>x</p></article>", "a\nb\nc"),
        ("<article><div class='post-header share-price'><p>a</p></div><div class='x ad'><p>x</p></div><div id='cookie-banner'><p>x</p></div></article>", "a"),
        ("<ul><li><a href='/'>menu</a></ul><article><p>a</p></article><h2>b</h2>", "a\nb"),
    ]
    for page, want in cases:
        assert html.main_text(page) == want, page[:200]


def test_contamination_by_pieces_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = "Ab cd éf GH 中文 ij2 kl".split()
    texts = [" ".join(rng.choices(words, k=n)) for n in (400, 3, 12, 11, 1)]
    items = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, texts[2]), (None, "ab"), (9, None), (8, "12 !"), (7, "")]
    long = texts[0].split()
    docs = [(i, " ".join(long[a : a + 25]) + " zz " + texts[i % 5]) for i, a in enumerate(range(0, 380, 19))] + [(50, None), (51, "ab cd"), (0, texts[1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    pieces = decontaminate.benchmark_pieces(bench, 10, 7).collect()
    assert max(len(r.text.split()) for r in pieces) == 16 and sum(r.item_id == 0 for r in pieces) > 50
    want = ordered(brute.decontaminate(docs, items, 10))
    assert collected(decontaminate.contamination(frame(spark, docs), bench)) == want
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    monkeypatch.setattr(decontaminate.find_occurrences, "__defaults__", (10, 100))
    assert decontaminate.benchmark_blocks(bench, 10, 100)[0] > 3
    assert collected(decontaminate.contamination(frame(spark, docs), bench)) == want


FURNITURE_NAMES = (
    "comment-list comments-area user-comments comment-body post-comments commentList cookie-bar notice-bar site-header site-footer"
    " sidebar-left main-nav ad-slot ad-container promo-box related-posts"
).split()


@pytest.mark.parametrize("name", FURNITURE_NAMES)
def test_html_leaves_out_furniture_by_telling_words(name):
    assert html.main_text(f"<article><p>Real text.</p><div class='x {name}'><p>bad</p></div></article>") == "Real text."
    assert html.main_text(f"<article><p>Real text.</p></article><section id='{name}'><p>bad, bad, bad</p></section>") == "Real text."


@pytest.mark.parametrize("name", "post-header share-price has-sidebar comments-open article-body ad-free search-results header-image".split())
def test_html_keeps_what_is_only_named_alike(name):
    assert html.main_text(f"<div class='{name}'><p>good</p></div>") == "good"


def test_html_keeps_what_holds_the_article():
    assert html.main_text("<div class='sidebar-right'><h1>Head</h1><p>good</p></div>") == "Head\ngood"
    assert html.main_text("<div class='promo-box'><article><p>good</p></article></div>") == "good"
    assert html.main_text("<div class='related-posts'><article><p>bad</p></article></div><article><p>good, good</p></article>") == "good, good"


@pytest.mark.parametrize("page,want", [
    ("<p title=it's>Hello", "Hello"), ('<a href="x>link', "link"), ("a < b <3 c", "a < b <3 c"), ("x <b", "x"), ("x <", "x <"), ("x </", "x </"),
    ("<p a='>'b>t", "t"), ("<p/ x = y>t", "t"), ("a<!-->b<!--->c<!-- - -> d -->e<!-- f", "abce"), ("a<!x>b<?y>c</ z>d", "abcd"), ("a&<b>lt;</b>", "a&lt;"),
    ("<SCRIPT>x</Scripty></script >t", "t"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"),
])
def test_html_reads_odd_markup(page, want):
    assert html.main_text(page) == want


def test_html_scores_decide(monkeypatch):
    long = "<p>" + "long text, " * 30 + "</p>"
    page = f"<div>Offer of the day</div><div><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><div><p>Short.</p></div><div>{long * 3}</div>"
    want = "\n".join(["Short.", *[("long text, " * 30).strip()] * 3])
    assert html.main_text(page) == want
    aside = f"<div><p>A box.</p></div><article>{long * 3}</article><h2>End</h2>"
    assert html.main_text(aside) == "\n".join([*[("long text, " * 30).strip()] * 3, "End"])
    scored = html.score

    def upside_down(order):
        for node in scored(order):
            node.points = 1 / node.points if node.points > 0 else 0.0
        return order

    monkeypatch.setattr(html, "score", upside_down)
    assert html.main_text(page) != want
    assert "A box." in html.main_text(aside)


@pytest.mark.parametrize("piece", ["<div>", "</i></div>", '<a href="', "<p><b>", "<ul><li>", "<!--", "<", "<script>", "<table><tr><td>", "<a b='>", "<header>", "<article>"])
def test_html_takes_linear_time(piece):
    start = time.monotonic()
    html.main_text(piece * (1_000_000 // len(piece)) + "x")
    assert time.monotonic() - start < 30


def test_licenses(spark):
    rows = corpus(3) + [
        (900, "Released under the MIT license. under the mit\nlicense"), (901, "CC-BY-NC, cc by nc and Apache License, version 2.0"),
        (902, licenses.TEMPLATES["gpl"][0]), (903, licenses.TEMPLATES["bsd"][0].upper()), (904, "gnu general public license alone"),
        (905, "under the mit"), (906, "noise " * 50 + licenses.TEMPLATES["mit"][0] + " noise"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    want = brute.base_licenses(rows, licenses.BASE)
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == want
    assert [got[i].labels for i in (902, 903, 904, 905, 906)] == ["gpl", "bsd", "", "", "mit"]
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got.values())


def test_licenses_of_a_file_with_all_notices(spark):
    notices = [text for text, _ in licenses.TEMPLATES.values()]
    rows = [(1, "\n".join(notices)), (2, "\n".join(notices[::-1] * 40)), *((10 + i, x) for i, x in enumerate(notices))]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got[1].labels == got[2].labels == ",".join(sorted(licenses.TEMPLATES))
    assert got[1].score == got[2].score == 1
    assert [x in got[10 + i].labels.split(",") for i, x in enumerate(licenses.TEMPLATES)] == [True] * len(notices)


def test_toxicity_held_out_and_odd_labels(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 3 > 0")
    odd = spark.createDataFrame([(None, 1, 1), (10**9, 1, 1), (1, None, 1)], labels.schema)
    chain = toxicity.train_chain(documents, known.union(odd), sample_rows=2_000)
    scored = toxicity.score_toxicity(documents, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").select("rejected", "toxic").toPandas()
    assert scored.rejected[scored.toxic == 1].mean() > 0.85  # some labels are noise
    assert scored.rejected[scored.toxic == 0].mean() < 0.01


def test_toxicity_without_labels(spark):
    rows = corpus(2, n=5, long=False)
    chain = toxicity.train_chain(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score_toxicity(frame(spark, rows), chain)
    assert got.count() == len(rows) and got.where("rejected").count() == 0
    assert toxicity.drop_toxic(frame(spark, rows), chain).count() == len(rows)


def test_later_model_reads_earlier_out_of_fold(monkeypatch):
    rng = np.random.default_rng(4)
    n = 600
    first, second = rng.integers(0, 2, n), rng.integers(0, 2, n)
    row = np.repeat(np.arange(n), 2)
    word = np.stack([first + 1, rng.integers(10, 90, n)], axis=1).ravel().astype(np.uint64)
    targets = np.stack([first, first | second], axis=1).astype(float)
    chain = toxicity.fit_chain(row, word, targets, np.arange(n) % toxicity.FOLDS, ["x", "y"], 50)
    assert chain.models[1].dense[0] > 0 and len(chain.models[0].dense) == 0
    odds = chain.log_odds(row, word, n)
    assert ((odds[:, 0] > 0) == (first == 1)).mean() > 0.97


@pytest.fixture(scope="module")
def piece_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def all_paths(model, text):
    done = {len(text): [(0.0, [])]}
    for s in range(len(text) - 1, -1, -1):
        done[s] = []
        for e in range(s + 1, min(len(text), s + model.longest) + 1):
            i = model.pieces.get(text[s:e])
            if i is not None:
                done[s] += [(model.scores[i] + x, [i, *y]) for x, y in done[e]]
        if text[s] not in model.pieces:
            done[s] += [(model.unknown + x, [*model.spell(text[s]), *y]) for x, y in done[s + 1]]
    return done[0]


def test_n_best_against_all_paths(piece_path):
    encoder, rng = pieces.Encoder(piece_path, 4), random.Random(3)
    for _ in range(100):
        text = "".join(rng.choices("ther on\n🙂é  ", k=rng.randint(0, 9)))
        ((normal, ids, base, own),) = encoder.encode([text])
        (got, alike), every = encoder.n_best(ids, base, own), all_paths(encoder.model, normal)
        assert [s for s, _ in got] == sorted((s for s, _ in every), reverse=True)[:4]
        assert {(s, tuple(x.tolist())) for s, x in got} <= {(s, tuple(y)) for s, y in every}
        assert len({tuple(x.tolist()) for _, x in got}) == len(got)
        for _, x in got:
            assert pieces.decode(encoder.model, x) == encoder.model.processor.decode(x.tolist()) == text


def test_lattice_and_joint_viterbi_agree(piece_path):
    model = pieces.Model(piece_path)
    words = ["▁the", "▁thering", "x" * 60, "▁" * 20, "中文字", "▁a\nb", "🙂🙂", "▁Entionble"]
    segmenter = pieces.Segmenter(model)
    segmenter.learn(words)
    for w in words:
        k = segmenter.number[w]
        best = pieces.Lattice(model, w).paths(2)
        assert segmenter.flat[segmenter.ends[k] : segmenter.ends[k + 1]].tolist() == best[0][1]
        assert segmenter.score[k] == best[0][0]
        assert segmenter.loss[k] == (best[0][0] - best[1][0] if len(best) > 1 else np.inf)


def test_long_texts_without_spaces(piece_path):
    rng, encoder = random.Random(7), pieces.Encoder(piece_path, 4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=200_000))
    lattice = pieces.Lattice(encoder.model, text[:10_000])
    tracemalloc.start()
    lattice.paths(4)
    assert tracemalloc.get_traced_memory()[1] < 2_000 * 10_000
    tracemalloc.stop()
    for t in (text, "ab" * 20_000):
        ((normal, ids, base, own),) = encoder.encode([t])
        found, alike = encoder.n_best(ids, base, own)
        assert len({tuple(x.tolist()) for _, x in found}) == 4
        assert all(pieces.decode(encoder.model, x) == t for _, x in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_piece_query_rows(spark, piece_path):
    rows = corpus(4) + [(None, "x"), (1, None)]
    got = pieces.encode_pieces(frame(spark, rows), piece_path, 3, keep_ids=True).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(len(r.ids) == r.n_pieces and r.scores == sorted(r.scores, reverse=True) for r in got)
    empty = [r for r in got if r.doc_id == 1]
    assert {(r.n_pieces, r.n_best) for r in empty} == {(0, 1)}


def test_empty_tables(spark, bpe, piece_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = SimpleNamespace(
        jaccard=lambda: jaccard.link_documents(docs, 3, 90), one=lambda: jaccard.keep_one(docs),
        decontaminate=lambda: decontaminate.contamination(docs, items), substrings=lambda: substrings.substring_dedup(docs),
        suffixes=lambda: suffixes.suffix_dedup(docs), licenses=lambda: licenses.scan_licenses(docs),
        toxic=lambda: toxicity.score_toxicity(docs, toxicity.train_chain(docs, labels)),
        tokens=lambda: tokenfiles.digest_token_files(tokenfiles.write_token_files(docs, bpe, 2)),
        pieces=lambda: pieces.encode_pieces(docs, piece_path),
        vectors=lambda: embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
        pages=lambda: html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
    )
    for name, run in vars(runs).items():
        assert run().collect() == [], name
    assert decontaminate.contamination(frame(spark, [(1, "a b")]), items).collect()[0].n_hit == 0


def test_pipeline_cuts_repeats_of_documents_without_n_chars(spark):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "x"), (2, "own " + passage, "y"), (3, None, None)], "doc_id long, text string, `a.b` string")
    cut = corpus_pipeline.repeated_passages(spark, docs, None)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect())) == [(1, passage, "x"), (2, "own", "y"), (3, None, None)]
