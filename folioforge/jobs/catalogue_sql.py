"""The SQL of the queries in catalogue.py, for another engine over the same tables."""

from __future__ import annotations

from ..operators.evaluation import poisson_edges

def _chunks(text: str = "text", size: int = 800, step: int = 700, source: str = "documents", keep: str = "doc_id", least: int = 100) -> str:
    return f"""select {keep}, (s // {step})::int as chunk_index, s::int as chunk_start, substring({text}, s + 1, {size}) as chunk
      from (select *, unnest(range(0, greatest(length({text}), 1), {step})) as s from {source}) where least(length({text}) - s, {size}) > {least}"""


_CUSTOM = "case when doc_id % 3 = 0 then text || chr(10) || 'References' || chr(10) || substring(text, 1, 50) || chr(10) || 'BIBLIOGRAPHY ' || chr(10) || 'end' else text end"
_GROUPS = "select source || '-' || (doc_id // 5) as grp, doc_id, '/lib/' || lower(source) || '/p' || doc_id || '.pdf' as path, sha256(text) as digest from documents"
_DONE = "select sha256(text) as digest, case when quality = 1 then 'notes/' || doc_id end as path from documents join labels using (doc_id)"
_COS = "1 - list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"
_L2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: pow({a}[i]::double - {b}[i]::double, 2)))"
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
_SLUG0 = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '[\\/:*?"<>|]+', '', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^[-_. ]+|[-_. ]+$', '', 'g')"""


def _yaml(x: str) -> str:
    return f"""case when coalesce({x}, '') = '' then '''''' when regexp_matches({x}, '^[0-9]+$') then {x} when regexp_matches({x}, '[:#{{}}\\[\\],&*?|<>=!%@`\\\\]') then '''' || replace({x}, '''', '''''') || '''' else {x} end"""


_NOTES = f"""select doc_id, '---' || chr(10) || 'title_en: ' || {_yaml("substring(replace(text, chr(10), ' '), 1, 30)")} || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'journal: ' || {_yaml("source || ': a'")} || chr(10) || '---' || chr(10) || chr(10) || text as content from documents"""

_LEDGER = """select doc_id * 2 as seq, 'doc-' || doc_id || chr(9) || 'old' as line from documents join labels using (doc_id)
  union all select doc_id * 2 + 1, case when toxic = 1 then 'doc-' || doc_id else 'doc-' || doc_id || chr(9) || md5(text) end from documents join labels using (doc_id) where quality = 1 or toxic = 1"""

_BM25 = f"""q as (select item_id, unnest(list_distinct({_TOKENS})) as token from benchmark),
w as (select doc_id, {_TOKENS} as tokens from documents),
s as (select count(*) as n_docs, avg(len(tokens)) as avg_len from w),
p as (select doc_id, len, token, count(*) as tf from (select doc_id, len(tokens) as len, unnest(tokens) as token from w) where token in (select token from q) group by all),
df as (select token, count(*) as df from p group by token),
bm as (select item_id, doc_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 4) as score
  from p join df using (token) join q using (token) cross join s group by item_id, doc_id),
lex as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, score from bm) where rank <= 10)"""

_HASH = f"""e as (select doc_id, b, sum(n) as n from (select doc_id, (('0x' || substring(md5(token), 1, 8))::bigint % 64) as b, 1 as n from (select doc_id, unnest({_TOKENS}) as token from documents)) group by all),
a as (select item_id, b, sum(n) as m from (select item_id, (('0x' || substring(md5(token), 1, 8))::bigint % 64) as b, 1 as n from (select item_id, unnest({_TOKENS}) as token from benchmark)) group by all),
nn as (select doc_id, sum(n * n) as nn from e group by doc_id),
sc as (select item_id, doc_id, round(dot::double / sqrt(nn::double), 6) as score from (select item_id, doc_id, sum(n * m) as dot from e join a using (b) group by all) join nn using (doc_id)),
he as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, score from sc) where rank <= 5)"""

_JUDGED = f"""asked as (select vec_id as query_id, embedding as q, label as q_label from embeddings where vec_id % 100 = 0),
sc as (select query_id, q_label, vec_id, label, {_COS.format(a="embedding", b="q")} as distance from embeddings join asked on vec_id <> query_id),
hits as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from sc) where rank <= 10),
j as (select *, case when vec_id % 9 <> 0 then (label = q_label)::int end as rel from hits),
rel as (select query_id, q_label as domain, (select count(*) from embeddings e where e.label = asked.q_label) as n_relevant from asked),
m as (select query_id, count(*) filter (coalesce(rel, 0) > 0) as hits, min(case when rel > 0 then rank end) as first, sum((pow(2.0, coalesce(rel, 0)) - 1) / log2(rank + 1.0)) as dcg, count(rel) as judged from j group by query_id)"""


def _topk(distance: str, k: int, query: int, where: str = "true") -> str:
    return f"select vec_id, label, row_number() over (order by distance, vec_id)::int as rank, distance from (select vec_id, label, {distance.format(a='embedding', b='q')} as distance from embeddings, (select embedding as q from embeddings where vec_id = {query}) where {where}) order by distance, vec_id limit {k}"


SQL = {
    "chunk_fixed_window": f"select 'group_' || substring(sha256(source), 1, 16) || '_file_' || substring(sha256(doc_id::varchar), 1, 16) || '_chunk_' || chunk_index as chunk_id, doc_id, chunk_index, chunk_start, md5(chunk) as chunk_md5 from ({_chunks(keep='doc_id, source')})",
    "chunk_stats_by_source": f"select source, sum(n)::bigint as n_chunks, round(avg(n), 4) as chunks_a_doc, round(sum(chars) / sum(covered) - 1, 4) as repeated from (select source, doc_id, count(*) as n, sum(length(chunk)) as chars, max(chunk_start + length(chunk)) as covered from ({_chunks(keep='doc_id, source')}) group by all) group by source",
    "chunk_overlap_variants": " union all ".join(f"select {a}::int as size, {b}::int as step, count(*) as n_chunks, sum(length(chunk))::bigint as n_chars from ({_chunks(size=a, step=b)})" for a, b in ((800, 700), (800, 400), (1600, 1400))),
    "truncate_last_references": f"""with t as (select doc_id, {_CUSTOM} as t from documents), c as (select doc_id, case when doc_id % 3 = 0 then substring(t, 1, length(t) - length(chr(10) || 'BIBLIOGRAPHY ' || chr(10) || 'end')) else t end as k from t)
      select doc_id, length(k)::int as kept_chars, md5(k) as kept_md5 from c""",
    "page_join_null_safe": "select conv_id, md5(string_agg(coalesce(case when role <> 'system' then text end, ''), chr(10) order by turn)) as text_md5 from conversations group by conv_id",
    "file_hash": "select doc_id, sha256(text) as file_hash, md5('doc-' || doc_id || '.md') as note_id from documents",
    "combined_hashes": f"""select grp, s as stable, l as legacy, (case when s = l then 1 else 2 end)::int as variants from
      (select grp, sha256(string_agg(digest, '' order by digest)) as s, sha256(string_agg(digest, '' order by path)) as l from ({_GROUPS}) group by grp)""",
    "neighbour_ids": f"""with c as (select 'group_' || substring(sha256(source), 1, 16) || '_file_' || substring(sha256(doc_id::varchar), 1, 16) || '_chunk_' as stem, chunk_index as i from ({_chunks(keep='doc_id, source')}))
      select stem || i as chunk_id, case when i > 0 then stem || (i - 1) end as prev_id, stem || (i + 1) as next_id from c""",
    "group_dedup_keep_first": "select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)",
    "dedup_priority_lookup": f"""with d as ({_DONE}), v as (select digest, min(path) as path from d where path is not null group by digest), l as (select distinct digest, true as there from d)
      select doc_id, case when v.path is not null then 'vault' when l.there then 'ledger' end as source_kind, v.path from (select doc_id, sha256(text) as digest from documents) x left join v using (digest) left join l using (digest)""",
    "prefilter_anti": f"select doc_id from documents where sha256(text) not in (select digest from ({_DONE}))",
    "prefilter_reasons": f"""with d as (select digest, bool_or(path is not null) as live from ({_DONE}) group by digest)
      select case when live then 'live_note_index' else 'processed_history' end as reason, count(*) as n from documents join d on sha256(text) = digest group by 1""",
    "ingest_plan": f"""with l as (select split_part(line, chr(9), 1) as name, arg_max(split_part(line, chr(9), 2), seq) as old from ({_LEDGER}) group by 1),
      p as (select distinct 'doc-' || doc_id as name, true as there from labels where doc_id % 7 <> 0),
      x as (select name, case when there is null or old is null then 'process' when old = '' then 'upgrade' when old <> digest then 'process' else 'skip' end as action from (select 'doc-' || doc_id as name, md5(text) as digest from documents) left join l using (name) left join p using (name))
      select action, count(*) as n, min(name) as first_name, max(name) as last_name from x group by action""",
    "ledger_audit": """with n as (select distinct md5(text) as v, true as a from documents), g as (select distinct v, true as b from (select md5(text) as v from documents join labels using (doc_id) union all select md5(doc_id::varchar) from labels where toxic = 1))
      select case when a and b then 'valid' when a then 'orphan' else 'ghost' end as state, count(*) as n from n full join g using (v) group by 1""",
    "ledger_alias_rewrite": """with x as (select doc_id, md5(doc_id::varchar) as legacy, sha256(text) as stable from documents), l as (select case when doc_id % 2 = 0 then legacy else stable end as value, doc_id as seq from x)
      select coalesce(a.stable, l.value) as value, min(seq) as seq from l left join (select legacy, stable from x where doc_id % 4 = 0) a on a.legacy = l.value group by 1""",
    "upsert_notes": "select doc_id, md5(text || '!') as digest, 2::int as version from documents where doc_id % 2 = 0 union all select doc_id, md5(text), 1::int from documents where doc_id % 3 <> 0 and doc_id % 2 <> 0",
    "replace_chunks": f"""select doc_id, count(*) as n_chunks, min(md5(chunk)) as least_digest from (
      {_chunks()} and doc_id not in (select doc_id from ({_chunks(size=400, step=400)}) where doc_id % 5 = 0) union all {_chunks(size=400, step=400)} and doc_id % 5 = 0) group by doc_id""",
    "group_commit": f"""select grp, n_chunks from (select grp, bool_or(coalesce(toxic = 1, false)) as failed, sum(length(text) // 700)::bigint as n_chunks from ({_GROUPS}) join documents using (doc_id) left join labels using (doc_id) group by grp) where not failed and n_chunks > 0""",
    "notes_topk_cosine": f"select vec_id, rank, round(1 - distance, 4) as score from ({_topk(_COS, 5, 0)})",
    "notes_topk_filtered": f"select vec_id, rank, round(1 - distance, 4) as score from ({_topk(_COS, 5, 0, 'label = 3')})",
    "papers_topk_l2": f"select vec_id, rank, round(distance, 4) as distance from ({_topk(_L2, 3, 7)})",
    "papers_filter_precedence": f"select vec_id, label, rank, round(distance, 4) as distance from ({_topk(_L2, 3, 7, 'label = 0')})",
    "topk_per_query": f"""select query_id, vec_id, rank, round(distance, 4) as distance from (select query_id, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id)::int as rank from
      (select query_id, vec_id, {_COS.format(a="embedding", b="q")} as distance from embeddings, (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0) where vec_id <> query_id)) where rank <= 5""",
    "hash_embed_topk": f"with {_HASH} select item_id, doc_id, rank, score from he",
    "context_stitch": f"""select doc_id, chunk_index, md5(concat_ws(' ', nullif(lag(chunk) over w, ''), '[MATCH]' || chunk || '[/MATCH]', nullif(lead(chunk) over w, ''))) as context_md5 from ({_chunks()}) window w as (partition by doc_id order by chunk_index)""",
    "note_to_paper_drilldown": f"""with k as (select distinct label from ({_topk(_COS, 5, 0)}))
      select label, vec_id, rank, round(distance, 4) as distance from (select label, vec_id, distance, row_number() over (partition by label order by distance, vec_id)::int as rank from
      (select label, vec_id, {_L2.format(a="embedding", b="q")} as distance from embeddings join k using (label), (select embedding as q from embeddings where vec_id = 0))) where rank <= 3""",
    "timeline_by_year": "select year(o_orderdate)::int as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
    "compare_by_group": f"select label, count(*) as n, min(rank)::int as best_rank, string_agg(lpad(vec_id::varchar, 9, '0'), ',' order by vec_id) as ids from ({_topk(_COS, 10, 3)}) group by label",
    "si_first": "select source, doc_id, is_si, place from (select source, doc_id, doc_id % 5 <> 0 as is_si, row_number() over (partition by source order by doc_id % 5 <> 0 desc, length(text), doc_id)::int as place from documents) where place <= 5",
    "lexical_bm25": f"with {_BM25} select item_id, doc_id, rank, score from lex",
    "rrf_hybrid": f"with {_BM25}, {_HASH} select item_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as rrf, count(*) as n_lists from (select item_id, doc_id, rank from lex union all select item_id, doc_id, rank from he) group by all",
    "evidence_containment": "select item_id, doc_id from documents d join benchmark b on contains(d.text, b.text)",
    "first_hit_gain": "select item_id, 1::bigint as gain, count(*) as hits from documents d join benchmark b on contains(d.text, b.text) group by item_id",
    "retrieval_metrics": f"with {_JUDGED} select query_id, hits, round(hits / n_relevant, 6) as recall, round(coalesce(1 / first, 0.0::double), 6) as mrr, round(dcg, 6) as dcg, judged from m join rel using (query_id)",
    "macro_average": f"with {_JUDGED} select round(avg(x), 6) as macro, count(*) as domains from (select domain, avg(coalesce(1 / first, 0.0::double)) as x from m join rel using (query_id) group by domain)",
    "bootstrap_ci": f"""with p as (select user_id, avg(value) filter (event_type = 'purchase') as a, avg(value) filter (event_type = 'click') as b from events group by user_id having a is not null and b is not null),
      w as (select sample, a - b as x, ('0x' || substring(md5(user_id || '|' || sample || '|7'), 1, 8))::bigint::double / 4294967296 as u from p, (select unnest(range(1000)) as sample)),
      m as (select sum(k * x) / nullif(sum(k), 0) as m from (select sample, x, {" + ".join(f"(u >= {e!r})::int" for e in poisson_edges())} as k from w) group by sample)
      select round(quantile_cont(m, 0.025), 6) as low, round(avg(m), 6) as mean, round(quantile_cont(m, 0.975), 6) as high from m""",
    "agreement_kappa": """with c as (select quality as a, toxic as b, count(*) as n from labels group by all), l as (select a, sum(n) as nx from c group by a), r as (select b, sum(n) as ny from c group by b)
      select round(1 - (select sum(abs(a - b) * n) from c)::double * (select sum(n) from c) / (select sum(abs(a - b) * nx * ny) from l, r), 6) as kappa, (select sum(n) from c)::bigint as n""",
    "fk_orphans": """select 'label_document' as rule, doc_id::varchar as id, count(*) as n from labels where doc_id not in (select doc_id from documents where doc_id % 11 <> 0) group by doc_id
      union all select 'line_order', l_orderkey::varchar, count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by l_orderkey
      union all select 'order_customer', o_custkey::varchar, count(*) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 100 <> 0) group by o_custkey""",
    "duplicate_ids": "select md5(text) as digest, count(*) as n from documents group by 1 having count(*) > 1",
    "partition_overlap": "select digest, string_agg(part, '+' order by part) as parts from (select distinct md5(text) as digest, ['D20', 'V20', 'H60'][doc_id % 3 + 1] as part from documents) group by digest having count(*) > 1",
    "quota_check": "select lang, count(*) as n, count(*) filter (quality = 1) as n_good, count(distinct source) as n_sources from documents join labels using (doc_id) group by lang having count(*) filter (quality = 1) >= 20",
    "attachment_parent_join": "select c_custkey, count(*) as n_files, count(distinct o_orderkey) as n_items, min(l_linenumber)::int as first_line from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_returnflag in ('R', 'A') group by c_custkey",
    "parent_key_fallback": """with a as (select s_suppkey, case when s_suppkey % 2 = 0 then replace(s_name, 'Supplier', 'Customer') else regexp_extract(s_name, '[0-9]+$') end as wanted from supplier),
      e as (select s_suppkey, c_custkey as k from a join customer on wanted = c_name), l as (select s_suppkey, min(c_custkey) as k from a join customer on contains(c_name, wanted) where s_suppkey not in (select s_suppkey from e) group by s_suppkey)
      select s_suppkey, coalesce(e.k, l.k) as parent_key from a left join e using (s_suppkey) left join l using (s_suppkey)""",
    "attachment_since_or": "select o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= '1998-01-01' or o_orderdate >= '1998-01-01' group by o_orderstatus",
    "limit_before_anti": "select doc_id from (select doc_id from documents order by doc_id limit 100) where doc_id not in (select doc_id from labels)",
    "route_model": """with x as (select doc_id, length(text) // 500 as p, ['article', 'review', 'textbook', 'letter'][doc_id % 4 + 1] as k, starts_with(text, 'The ') as o, starts_with(text, 'La') as r, contains(lower(source), 'a') and length(text) > 5000 as m from documents),
      y as (select doc_id, case when o then 'manual override (--model)' when p >= 30 then 'primary_pdf_pages >= 30' when p * 2 >= 60 then 'total_pdf_pages >= 60' when k in ('textbook', 'phd-dissertation', 'review', 'perspective', 'commentary') then 'document_type=' || k when r then 'is_review_like=true' when m then 'is_multichapter_thesis=true' else 'default flash route' end as reason from x)
      select doc_id, case when reason = 'default flash route' then 'flash' when reason like 'manual%' then 'given-model' else 'pro' end as model, reason from y""",
    "fallback_trigger": """with x as (select doc_id, case when len(regexp_extract_all(text, '[A-Za-z]{13,}')) > 2 then 1 else 0 end as hi, case when len(regexp_extract_all(text, '[0-9]{4,}')) > 0 then 1 else 0 end as md, case when len(regexp_extract_all(text, '[A-Za-z]{11,12}')) > 1 then 2 else 0 end as lo, lang, text from documents)
      select doc_id, case when hi + md + lo = 0 then 'candidate tags empty after deterministic prefill' when hi + md = 0 and hi + md + lo <= 1 then 'candidate tags remain very sparse after deterministic prefill'
      when lower(substring(text, 1, 1)) = 't' then 'generic fallback template may need semantic candidate supplementation' when lang = 'de' then 'research_domain=other triggers edge-theme fallback'
      when starts_with(text, 'La') then 'scope_hint=other triggers fallback review' when length(text) < 400 and hi + md = 0 then 'signal_quality=weak with no high/medium candidates' else 'candidate tags already populated' end as reason from x""",
    "split_plan": "select doc_id, greatest(1, ceil(strlen(text) / 2000), ceil(ceil(length(text) / 500) / 10))::bigint as parts from documents",
    "seed_term_grounding": r"""with w as (select doc_id, string_split_regex(text, '[ \n]+') as w, text as a from (select doc_id, coalesce(text, '') as text from documents)),
      c as (select doc_id, regexp_replace(lower(w[-1]), '[^\p{L}\p{N}]', '', 'g') as l, regexp_replace(lower(w[1]), '[^\p{L}\p{N}]', '', 'g') as f, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') as a from w)
      select doc_id, l <> '' and a <> '' and (l = a or (length(l) >= 6 and contains(a, l)) or (length(a) >= 6 and contains(l, a))) as last_grounded, f <> '' and a <> '' and (f = a or (length(f) >= 6 and contains(a, f)) or (length(a) >= 6 and contains(f, a))) as first_grounded from c""",
    "slug_language_title": rf"""with s as (select conv_id, turn, text, regexp_replace(substring({_SLUG0}, 1, 32), '[-_. ]+$', '') as s, trim(regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], 'query'), '\s+', ' ', 'g')) as t from conversations)
      select conv_id, turn, case when s = '' then 'query' else s end as slug, case when coalesce(text, '') = '' then 'unknown' when regexp_matches(text, '[一-鿿]') then 'zh' else 'en' end as hint, case when t = '' then 'Untitled session' else regexp_replace(substring(t, 1, 120), '[ .,;:]+$', '') end as title from s""",
    "frontmatter_render": f"select doc_id, md5(content) as content_md5 from ({_NOTES})",
    "frontmatter_parse": "select doc_id, doc_id::varchar as parsed_id, source || ': a' as journal, md5(regexp_replace(chr(10) || chr(10) || text, '^\\s*\\n', '')) as body_md5 from documents",
    "note_validation": f"""with n as (select doc_id, case when doc_id % 6 = 0 then content || chr(10) || 'warnings: x' else content end as c from ({_NOTES})),
      v as (select doc_id, starts_with(c, '---' || chr(10)) and contains(c, chr(10) || '---' || chr(10)) as front, length(trim(string_split(c, chr(10) || '---' || chr(10) || chr(10))[-1])) > 0 as body,
        len(list_filter(['tag_review_status:', 'candidate_needed:', 'candidate_needed_raw_terms:', 'routing_evidence:', 'warnings:', 'body_evidence_targets:'], lambda x: contains(c, x)))::int as n_forbidden from n)
      select *, front and body and n_forbidden = 0 as ready from v""",
    "public_hits": f"select 'paper-' || vec_id as paper_id, rank, round(1 - distance, 4) as score from ({_topk(_COS, 5, 0)})",
    "query_log_idempotent": "select month, count(*) as n_logs, min(event_id) as first_event from (select user_id, event_type, strftime(ts, '%Y-%m') as month, min(event_id) as event_id from events group by all) group by month",
    "session_runs": "select conv_id, count(*) as n_turns, count(*) filter (role = 'user') as n_user, arg_max(role, turn) as last_role from conversations group by conv_id",
    "pending_runs": "select user_id, arg_max(event_id, (ts, event_id)) as newest from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 120) group by user_id",
    "archive_rollup": "select user_id, count(*) as n, round(sum(value), 2) as total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest from events group by user_id",
    "index_status": "select count(*) as n_rows, min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim, count(*) filter (len(embedding) <> 64) as n_wrong, coalesce(min(len(embedding)) = 64, false) as ready from embeddings",
    "stream_incremental_index": f"select doc_id, count(*) as n_chunks from ({_chunks()}) group by doc_id",
    "user_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
      s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g), c as (select user_id, k, count(*) as n from s group by all)
      select user_id, count(*) as n_sessions, max(n) as longest from c group by user_id""",
}
