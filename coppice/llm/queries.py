"""The queries of the ten operators and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, langid, licenses, mixing, neardup, resample, rules, tokencount, topk, toxicity
from .common import crc_mod, documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    good, labelled = labels.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    return resample.resample(documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"), share=good / labelled if labelled else 1.0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.train(docs)
    return langid.identify(docs.select("doc_id", "text"), net).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), digest=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


OP1_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), found as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from vectors q join vectors c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from found
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""

OP3_SQL = r"""
with base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), windows as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from base where len(w) >= 3)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from windows) where n > 1
), covered as (
  select rid, count(distinct p) as n_repeat from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid
), lines as (
  select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from base
), found as (
  select doc_id, cast(len(w) as bigint) as n_words,
         cast(coalesce(length(array_to_string(w, '')), 0) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) as bigint) as n_lines,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat, 0) as bigint) as n_repeat_words,
         length(regexp_replace(t, '\P{Lu}+', '', 'g')) as capitals
  from base join lines using (rid) left join covered using (rid)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from found
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines
            or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * capitals > word_chars) as kept
from judged
"""

OP4_SQL = """
with sizes as (
  select source as s, sum(length(coalesce(text, ''))) as size from documents group by source
), total as (
  select cast(count(*) as double) as sources, cast(sum(size) as double) as all_size from sizes
), rated as (
  select s, case when size > 0 then 1.0::double / sources * 1.0::double * all_size / cast(size as double) else 0.0 end as rate from sizes, total
), steps as (
  select s, rate, k, sum(case when rate > 0 then exp(-rate + k * ln(rate) - lgamma(k + 1)) else cast(k = 0 as double) end)
         over (partition by s order by k) as c
  from rated, (select cast(range as double) as k from range(0, 120))
), drawn as (
  select d.*, rate, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':1:1'), 1, 13) as bigint) / 4503599627370496.0::double as u
  from documents d join rated on d.source is not distinct from s
), counted as (
  select drawn.*, (select count(*) from steps where steps.s is not distinct from drawn.source and c <= u) as n from drawn
), copies as (
  select doc_id, text, lang, source, n_chars, rate, unnest(range(1, n + 1)) as copy_no from counted
)
select doc_id, text, lang, source, n_chars, cast(copy_no as integer) as copy_no, rate,
       cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':1:order:' || copy_no), 1, 13) as bigint) / 4503599627370496.0::double as shuffle_key
from copies
"""

QUERIES = {f.__name__: f for f in (op1_topk_search, op2_importance_resampling, op3_quality_rules, op4_source_mixing, op5_license_scan, op6_toxicity, op7_language, op8_bpe_codec, op9_token_counts, op10_minhash_neardup)}
SQL = {"op1_topk_search": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_source_mixing": OP4_SQL}
