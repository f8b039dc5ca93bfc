"""A training-corpus pipeline over the ``documents`` table, in five stages.

Documents that the toxicity chain rejects go; of every group of near copies (five-word shingles,
similarity 0.8 or more) one stays; word windows that start in an earlier document are cut; documents
that hold a benchmark passage go; what is left is encoded into SentencePiece ids. Every stage works
on all rows its predecessor kept, and its result is a Parquet table that the next one reads.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontaminate import clean_documents
from flowlens.llm.jaccard import keep_one
from flowlens.llm.pieces import encode_pieces
from flowlens.llm.queries import Query, piece_model, table
from flowlens.llm.substrings import remove_repeats
from flowlens.llm.toxicity import drop_toxic, train_chain
from flowlens.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train_chain(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, window=13)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return cut.select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, piece_model(), keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: No SQL: two of the stages are models that SQL cannot state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = Query(run, ORACLE_SQL)
