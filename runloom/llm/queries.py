"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, html_text, media, mixing, packing, simhash, suffix_dedup, token_files, toxicity, urls
from .common import table

#: The rules of op3.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_media_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), digests=True)


def op5_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "rejected")


def op8_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_main_text": op2_main_text,
    "op3_url_digest_filter": op3_url_digest_filter,
    "op4_media_wav": op4_media_wav,
    "op5_simhash_bk": op5_simhash_bk,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity_ordinal": op7_toxicity_ordinal,
    "op8_prefix_free_dedup": op8_prefix_free_dedup,
    "op9_hnsw_shards": op9_hnsw_shards,
    "op10_source_mix": op10_source_mix,
}

ORACLES: dict[str, str] = {
    "op3_url_digest_filter": r"""
with parsed as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path
  from pages),
rules(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits as (
  select page_id, host, path, max_by(rh || rp, length(rh || rp)) rule, max_by(v, length(rh || rp)) verdict
  from parsed left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by all)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from hits""",
    "op10_source_mix": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint / 4503599627370496::double u
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
p as (select *, row_number() over (order by source asc nulls last) place from s),
w as (select *, [3, 1, 2][((place - 1) % 3 + 1)::int]::bigint w from p),
c as (
  select *, coalesce(sum(2 * source_size) over b, 0)::bigint caps, coalesce(sum(w) over b, 0)::bigint used,
    sum(source_size) over ()::bigint total, sum(w) over ()::bigint ws
  from w window b as (order by source_size::double / w, place rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5::double * total - caps) / (ws - used)::double lvl from c),
f as (select *, (2 * source_size)::double <= w * lvl full_up from l),
t as (select source, source_size,
    case when full_up then (2 * source_size)::double else w * (select min_by(lvl, (source_size::double / w, place)) from f where not full_up) end target
  from f),
r as (select d.doc_id, d.size, t.source_size, t.target, u, case when t.source_size > 0 then t.target / t.source_size else 0 end rate
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint taken from r""",
}
