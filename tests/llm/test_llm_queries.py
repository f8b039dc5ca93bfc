"""Registered queries against their SQL, and the pipeline against its stages' brute force."""

import pytest

import corpus_pipeline
from flowlens.llm.queries import llm_queries
from tests.compare import compare, connect
from tests.llm import brute

QUERIES = llm_queries()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], sf_dir) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_one_row_for_each_input_row(spark, sf_dir, name):
    rows = spark.read.parquet(f"{sf_dir}/{'pages' if 'html' in name else 'documents'}.parquet").count()
    assert QUERIES[name].run(spark, sf_dir).count() == rows


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "ngram_jaccard":
            groups = brute.jaccard(list(before.items()), 5, 80)
            assert set(after) == {i for i, (n, c) in groups.items() if i == c or not n}
        if name == "substring_dedup":
            gone = {i: (g, d) for i, _, g, d in brute.substrings(list(before.items()), 13)}
            for i, text in after.items():
                assert text == before[i] if not gone[i][0] else brute.sha(text.encode()) == gone[i][1]
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {r[0] for r in brute.decontaminate(list(before.items()), items, 10) if not r[-1]}
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == set(before) and all(r.round_trip for r in out)


def test_pipeline_gives_the_ids(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert {i: len(r.ids) for i, r in out.items()} == {i: r.n_pieces for i, r in out.items()} and len(out[1].ids) > 0
