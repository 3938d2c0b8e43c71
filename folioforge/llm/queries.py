"""The queries of the training-data operators, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, exact, language, mixing, periods, pii, secrets, simhash, substrings, urls, vectors
from .common import table

#: The rules of the url query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(documents, secrets.markov_table(documents)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.where(~language.held_out(F.col("doc_id"))))
    return language.predict(documents, model)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and where none fits the mirrors that the crawl itself shows: addresses of a body that a smaller address serves too."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return urls.block_listed(judged, urls.mirror_list(pages))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents")).drop("text")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find(table(spark, sf_dir, "documents"), plant=True)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    own = [op1_secret_scan, op2_language_id, op3_url_filter, op4_decontamination, op5_substring_dedup, op6_simhash_dedup, op7_pii, op8_embedding_dedup, op9_mixing, op10_chat_format, op11_exact_dedup, op12_periodic_runs, op13_tokenizer_alignment]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_HOST_PATH = r"""
  select page_id, html,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
"""

OP3_SQL = f"""
with p as ({_HOST_PATH}),
rules(rhost, rpath, rverdict) as (values {", ".join(f"('{h}', '{q}', '{v}')" for h, q, v in RULES)}),
fits as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(rverdict, length(rhost || rpath)) as rverdict
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
served as (select distinct sha256(html) as body, host, path from p where host <> '' and html <> ''),
least as (select body, min(host || path) as least from served group by body having count(*) > 1),
mirrors as (select distinct host, path from served join least using (body) where host || path <> least)
select p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, case when m.host is not null then 'block' else 'allow' end) as verdict
from p left join fits f using (page_id) left join mirrors m on p.host = m.host and p.path = m.path
"""

OP10_SQL = r"""
with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations where conv_id is not null),
h as (select conv_id, pos, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as line,
  md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) as m from t),
r as (select conv_id, pos, md5(string_agg(m, ',') over (partition by conv_id order by pos)) as h from h),
n as (select conv_id, max(pos) as n_turns from t group by conv_id),
ends as (select r.conv_id, n_turns, h from r join n on r.conv_id = n.conv_id and r.pos = n.n_turns),
single as (select n_turns, h, min(conv_id) as conv_id, count(*) as n_same from ends group by n_turns, h),
kept as (select s.* from single s anti join (select r.pos as n_turns, r.h from r join n using (conv_id) where r.pos < n.n_turns) i on s.n_turns = i.n_turns and s.h = i.h)
select h.conv_id, (h.pos - 1) // 256 as part, any_value(k.n_turns)::bigint as n_turns, any_value(k.n_same)::bigint as n_same, string_agg(line, '' order by pos) as text
from h join kept k using (conv_id) group by h.conv_id, (h.pos - 1) // 256
"""

OP11_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by doc_id nulls last)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op10_chat_format": OP10_SQL, "op11_exact_dedup": OP11_SQL}
