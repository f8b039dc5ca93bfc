"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontaminate import contamination
from flowlens.llm.embeddings import near_vectors
from flowlens.llm.html import extract_pages
from flowlens.llm.infilling import infill
from flowlens.llm.jaccard import link_documents
from flowlens.llm.licenses import scan_licenses
from flowlens.llm.likelihood import score_texts
from flowlens.llm.pieces import encode_pieces
from flowlens.llm.substrings import substring_dedup
from flowlens.llm.suffixes import suffix_dedup
from flowlens.llm.tokenfiles import digest_token_files, write_token_files
from flowlens.llm.toxicity import score_toxicity, train_chain
from flowlens.llm.whitening import whiten


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(table(spark, sf_dir, "documents"), k=3, percent=90)
    return linked.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, train_chain(documents, table(spark, sf_dir, "labels")))


def suffix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return digest_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer, end_id=2))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_encoding(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), model or piece_model())


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def lattice_likelihood(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), vocabulary or piece_model())


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill(table(spark, sf_dir, "documents"))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD_SQL = rf"""
with recursive docs as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') as s from
  (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id != b.doc_id
  group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 90 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from docs union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reach group by a) left join sizes using (doc_id)"""

DECONTAMINATE_SQL = rf"""
with docs as (select doc_id, {LETTER_WORDS} as w from documents),
items as (select item_id, w, least(len(w), 10) as m from
  (select item_id, {LETTER_WORDS} as w from benchmark where item_id is not null) where len(w) > 0),
patterns as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as p from
  (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from items)),
lengths as (select distinct m from patterns),
windows as (select doc_id, i, d.m, array_to_string(w[i:i + d.m - 1], ' ') as p from
  (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, lengths where len(w) >= m) d),
found as (select doc_id, i, w.m, item_id from windows w join patterns using (m, p)),
hit as (select doc_id, count(distinct j) as n_hit from
  (select doc_id, unnest(range(i, i + m)) as j from (select distinct doc_id, i, m from found)) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items,
  array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as names from found group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)"""


SUBSTRING_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as p from
  (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by p) as f from windows) where f < doc_id),
gone as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 13)) as j from late)),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from docs),
kept as (select doc_id, string_agg(word, ' ' order by j) as t from placed anti join gone using (doc_id, j) group by doc_id),
counted as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (doc_id) left join counted using (doc_id)"""


EMBEDDING_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
parts as (select a as vec_id, min(b) as component_id from reach group by a),
counted as (select a as vec_id, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from parts left join counted using (vec_id)"""


INFILL_SQL = """
with docs as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w,
  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select doc_id, t, w, len(w) as n, cast('0x' || h[1:8] as bigint) % (len(w) + 1) as x,
  cast('0x' || h[9:16] as bigint) % (len(w) + 1) as y, cast('0x' || h[17:24] as bigint) % 100 as h3,
  cast('0x' || h[25:32] as bigint) % 100 as h4 from docs),
parts as (select doc_id, t, n, array_to_string(w[1:least(x, y)], '') as p,
  array_to_string(w[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(w[greatest(x, y) + 1:], '') as s,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain'
    when h4 < 20 then 'spm' else 'psm' end as form from drawn),
made as (select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
  else '<S>' || s || '<P>' || p || '<M>' || m end as o from parts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars, sha256(o) as output_sha256,
  sha256(t) as restored_sha256
from made"""


def llm_queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": Query(ngram_jaccard, JACCARD_SQL),
        "op2_decontaminate": Query(decontaminate, DECONTAMINATE_SQL),
        "op3_substring_dedup": Query(substring_removal, SUBSTRING_SQL),
        "op4_html_extract": Query(html_extract),
        "op5_toxicity": Query(toxicity),
        "op6_suffix_dedup": Query(suffix_removal),
        "op7_token_files": Query(token_files),
        "op8_embedding_dedup": Query(embedding_dedup, EMBEDDING_SQL),
        "op9_license_scan": Query(license_scan),
        "op10_piece_encoding": Query(piece_encoding),
        "op11_lattice_likelihood": Query(lattice_likelihood),
        "op12_fill_in_middle": Query(fill_in_middle, INFILL_SQL),
        "op13_embedding_whitening": Query(embedding_whitening),
    }
