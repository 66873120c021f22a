"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, chat, divergence, lm_scoring, packing, quality, sentencepiece_codec, sharding, simhash, toxicity, url_filter, vectors
from .common import fold, table

TOKENIZER, PIECES, RANKS = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    return lm_scoring.score(docs)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids (their number and checksum), whether both libraries agree on them, and whether decoding gives the text back."""
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(PIECES), restored=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "parity", "restored")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 4) == 2)
    model = toxicity.train(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = quality.cut(quality.measure(docs).drop("text"))
    judged = quality.judge(measured, quality.calibrate(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return byte_bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(RANKS), PATTERN).drop("text")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroids(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


OP1_SQL = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r as (select * from (values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                            ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) as t(h, s, rule, verdict))
select page_id, host, path, x.rule as rule, coalesce(x.verdict, 'allow') as verdict
from (select p.*, (select max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) from r
                   where (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.s)) as x from p)
"""


OP7_SQL = """
with t as (
  select conv_id, turn, replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(10), ' ') as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
r as (
  select t.*, p.perspective,
         case when speaker = 'system' then '<|system|>' when speaker = perspective then '<|assistant|>' else '<|user name=' || speaker || '|>' end || chr(10) as head
  from t join p on t.conv_id is not distinct from p.conv_id),
s as (select *, head || body || '<|end|>' || chr(10) as segment from r),
o as (
  select *, row_number() over w - 1 as position, sum(length(segment)) over (w rows unbounded preceding) as upto from s
  window w as (partition by conv_id, perspective order by turn nulls last, speaker, body))
select conv_id, perspective, cast(position as bigint) as position, turn, speaker, segment, cast(upto - length(segment) as bigint) as start, cast(upto as bigint) as "end",
       cast(case when speaker = perspective then upto - length(segment) + length(head) end as bigint) as mask_start
from o
"""


OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct r) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v from k group by 1),
n as (select lang, source, coalesce(sum(n), 0) as n from g left join c using (lang, source) group by 1, 2),
p as (select n.lang, n.source, k.term, coalesce(c.n, 0) as count, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (n.n + 5 * v) as p
      from n join k using (lang) join v using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
q as (select k.lang, k.term, 1 + 1000000000 * (sum(c.n) + 5) // (any_value(t.n) + 5 * any_value(v)) as q
      from k join c using (lang, term) join v using (lang) join (select lang, sum(n) as n from c group by 1) t using (lang) group by 1, 2),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where count > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op7_chat_formatting": OP7_SQL, "op11_source_divergence": OP11_SQL}
