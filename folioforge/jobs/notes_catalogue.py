"""More queries over the driver's tables: notes, paths, ledgers and evaluation sets; their SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes
from ..operators import search
from ..sources.tables import json_lines, table, whole
from .catalogue import _query_vector
from .catalogue_sql import _COS, _L2, _TOKENS, _topk

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_RAW = "'draft/' || replace(coalesce(text, ''), chr(10), ' ') || case doc_id % 4 when 0 then ' — v2.pdf' when 1 then '-review_note.md' when 2 then '  -  x__y' else '' end"


def _raw(docs):
    tail = F.when(F.col("doc_id") % 4 == 0, " — v2.pdf").when(F.col("doc_id") % 4 == 1, "-review_note.md").when(F.col("doc_id") % 4 == 2, "  -  x__y").otherwise("")
    return F.concat(F.lit("draft/"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), tail)


_NAME = _RAW
for _p, _r in ((r"^.*/", ""), ("[—–－‑‒―]", "-"), (r"[\r\n\t]", " "), (r"""[`*"''\\/:?<>|]""", ""), (r"\s+", " "), (r"\s*-\s*", "-"), (r"\s*_\s*", "_"), ("-{2,}", "-"), ("_{2,}", "_"), (r"\.[^.]*$", ""), (r"^[ .\-_]+|[ .\-_]+$", "")):
    _NAME = f"regexp_replace({_NAME}, '{_p}', '{_r}', 'g')"


@query(f"""with n as (select doc_id, case when x = '' then 'note' else x end as x from (select doc_id, {_NAME} as x from documents))
  select doc_id, case when regexp_matches(x, '(^|[_-])review_note$', 'i') then regexp_replace(x, '-review_note$', '_review_note', 'i') else x || '_review_note' end || '.md' as name from n""")
def note_file_names(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", notes.note_file_name(_raw(docs), "note").alias("name"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'Name ' || doc_id || ' x.md' end as recommended from documents""")
def recommended_names(spark, d):
    """Every third note names a file in a line of its own, with Markdown around it; a line without a colon before it doesn't count."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[:：]", " ").alias("text"))
    line = F.concat(F.lit(f"\n{notes.NAME_LABEL} none\n> - **{notes.NAME_LABEL}**：`Name "), F.col("doc_id").cast("string"), F.lit(" x.md`\n"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", line, F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", notes.recommended_name(body).alias("recommended"))


@query(f"""select doc_id, md5(case doc_id % 3 when 0 then '# {notes.BIBLIOGRAPHY}' || chr(10) || 'a' || chr(10) || chr(10) || '{notes.ABSTRACT}' || chr(10) || 'abs' || chr(10) || chr(10) || '## next' || chr(10) || trim(replace(text, '#', ' '), chr(10) || ' ')
  when 1 then '{notes.ABSTRACT}' || chr(10) || 'abs' || chr(10) || chr(10) || 'x' || replace(text, '#', ' ') || 'x' else 'x' || replace(text, '#', ' ') || chr(10) || '{notes.ABSTRACT}' end) as body_md5 from documents""")
def section_injection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("#"), F.lit(" ")).alias("text"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"# {notes.BIBLIOGRAPHY}\na\n## next\n"), F.regexp_replace("text", r"^[\n ]+|[\n ]+$", ""))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x"), "text", F.lit("x"))).otherwise(F.concat(F.lit("x"), "text", F.lit(f"\n{notes.ABSTRACT}")))
    return docs.select("doc_id", F.md5(notes.with_section(body, F.lit(f"{notes.ABSTRACT}\nabs"))).alias("body_md5"))


_FRONT = """'---' || chr(10) || 'title: ' || split_part(text, chr(10), 1) || chr(10) || case when text like 'A%' or text like 'D%' then 'combined_hash: ' || md5(text) || chr(10) else '' end
  || case when lang = 'en' then 'parent_key: ' || upper(substring(md5(text), 1, 8)) || chr(10) else '' end || case when lang in ('en', 'de') then 'pdf_0_path: a/' || source || '.pdf' || chr(10) || 'pdf_1_path: b/' || lang || '.pdf' || chr(10) else '' end
  || 'year: ' || length(text) || chr(10) || '---' || chr(10) || replace(text, chr(10), ' ')"""


def _front(docs):
    """Notes cut from texts: some with a hash, a key or paths of their own."""
    line = lambda holds, *parts: F.when(holds, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))).otherwise("")
    two, text = F.col("lang").isin("en", "de"), F.col("text")
    return F.concat(
        F.lit("---\ntitle: "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\n"), line(text.startswith("A") | text.startswith("D"), "combined_hash: ", F.md5("text")), line(F.col("lang") == "en", "parent_key: ", F.upper(F.substring(F.md5("text"), 1, 8))),
        line(two, "pdf_0_path: a/", F.col("source"), ".pdf"), line(two, "pdf_1_path: b/", F.col("lang"), ".pdf"), F.lit("year: "), F.length("text").cast("string"), F.lit("\n---\n"), F.replace("text", F.lit("\n"), F.lit(" ")),
    )


@query(rf"""with n as (select doc_id, {_FRONT} as c, 'combined_hash: ' || sha256(text) as h from (select * replace (coalesce(text, '') as text, coalesce(lang, 'und') as lang, coalesce(source, 'none') as source) from documents))
  select doc_id, md5(case when contains(c, chr(10) || 'combined_hash:') then regexp_replace(c, '\ncombined_hash:[^\n]*', chr(10) || h) when contains(c, chr(10) || 'parent_key:') then regexp_replace(c, '\n(parent_key:[^\n]*)', chr(10) || '\1' || chr(10) || h)
    when contains(c, chr(10) || 'pdf_1_path:') then regexp_replace(c, '\n(pdf_1_path:[^\n]*)', chr(10) || '\1' || chr(10) || h) else replace(c, chr(10) || '---' || chr(10), chr(10) || h || chr(10) || '---' || chr(10)) end) as content_md5 from n""")
def hash_backfill(spark, d):
    docs = whole(table(spark, d, "documents"))
    return docs.select("doc_id", F.md5(notes.with_hash(_front(docs), F.sha2("text", 256))).alias("content_md5"))


@query(r"""with w as (select doc_id, list_filter(list_transform(w, lambda x, i: {'n': i - 1, 'p': x}), lambda x: length(x.p) > 3 and regexp_matches(x.p, '^[A-Za-z]+$')) as f from (select doc_id, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') as w from documents))
  select doc_id, array_to_string(list_transform(f, lambda x: x.p), ',') as by_number, array_to_string(list_transform(list_filter(list_transform(range(1, len(f) + 1), lambda i: {'i': i - 1, 'x': f[i]}), lambda y: y.x.n = y.i), lambda y: y.x.p), ',') as until_gap from w""")
def pdf_path_dialects(spark, d):
    """Paths of the lines pdf_N_path, N the place of a longer word of the text: all by number, and only those up to the first gap. The lines stand in reverse order."""
    docs = whole(table(spark, d, "documents"), "text")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    numbered = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: (F.length(x["w"]) > 3) & x["w"].rlike("^[A-Za-z]+$"))
    block = F.array_join(F.reverse(F.transform(numbered, lambda x: F.concat(F.lit("pdf_"), x["i"].cast("string"), F.when(x["i"] % 2 == 0, "_path: '").otherwise("_path:  "), x["w"], F.when(x["i"] % 2 == 0, "'").otherwise("")))), "\n")
    found = notes.pdf_paths(block)
    return docs.select("doc_id", F.array_join(F.transform(found, lambda x: x["p"]), ",").alias("by_number"), F.array_join(notes.paths_until_gap(found), ",").alias("until_gap"))


@query("""with p as (select l_orderkey, l_linenumber, lpad(l_orderkey::varchar, 8, '0') as k, case l_linenumber % 3 when 0 then 'storage:f' || l_partkey || '.pdf' when 1 then 'attachments:sub/f.pdf' else '/abs/storage/ABCD1234/g.pdf' end as path from lineitem)
  select l_linenumber % 3 as kind, count(*) as n, min(case l_linenumber % 3 when 0 then '/data/storage/' || k || '/' || replace(path, 'storage:', '') when 1 then '/base/sub/f.pdf' else path end) as least, count(distinct case l_linenumber % 3 when 0 then k when 2 then 'ABCD1234' end) as keys from p group by 1""")
def path_schemes(spark, d):
    key = F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    kind = F.col("l_linenumber") % 3
    path = F.when(kind == 0, F.concat(F.lit("storage:f"), F.col("l_partkey").cast("string"), F.lit(".pdf"))).when(kind == 1, "attachments:sub/f.pdf").otherwise("/abs/storage/ABCD1234/g.pdf")
    full = notes.resolved_path(path, key, "/data", "/base")
    rows = table(spark, d, "lineitem").select(kind.alias("kind"), full.alias("full"), notes.storage_key(full).alias("key"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("full").alias("least"), F.count_distinct("key").alias("keys"))


@query("""with c as (select user_id, [coalesce(arg_min(event_type, event_id), ''), coalesce(arg_max(event_type, event_id), ''), case when max(value) > 90 then 'purchase' else 'view' end] as l from events group by user_id),
  m as (select user_id, list_transform(l, lambda t: case t when 'view' then 'index_note' when 'click' then 'tag_prefill' when 'purchase' then 'index_note' when 'error' then 'none' when 'signup' then 'tag_prefill' else 'other' end) as a from c)
  select user_id, case when list_contains(a, 'none') then '' else a[1] || case when a[2] <> a[1] then ',' || a[2] else '' end || case when a[3] <> a[1] and a[3] <> a[2] then ',' || a[3] else '' end end as actions from m""")
def action_lists(spark, d):
    """A user's first, last and kind of dearest event as a list of actions: dashes, commas, spaces and repeats; an error cancels all."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"), F.max("value").alias("top"))
    raw = F.concat(F.upper("first"), F.lit(", "), F.col("last"), F.lit("  "), F.when(F.col("top") > 90, "purchase").otherwise("view"))
    listed = notes.actions(raw, {"view": "index_note", "purchase": "index_note", "click": "tag_prefill", "signup": "tag_prefill", "error": "none", "none": "none"}, ["tag_prefill"])
    return by.select("user_id", F.array_join(listed, ",").alias("actions"))


@query("""with n as (select p_partkey, case when p_name like '%widget' then 'gemini-' || p_type when p_name like '%ring' then '' when p_size < 10 then lower(substring(p_type, 1, 3)) else p_name end as asked from part)
  select p_partkey, case when asked = '' then 'F' when lower(asked) like '%gemini%' and lower(asked) like '%pro%' then 'P' when lower(asked) like '%gemini%' and lower(asked) like '%flash%' then 'F' when lower(asked) = 'pro' then 'P' when lower(asked) in ('flash', 'mini', 'haiku') then 'F' else asked end as model from n""")
def model_names(spark, d):
    """Names and types of parts as names of models: tiers are found by their words, other names stay."""
    name = F.col("p_name")
    asked = F.when(name.endswith("widget"), F.concat(F.lit("gemini-"), "p_type")).when(name.endswith("ring"), "").when(F.col("p_size") < 10, F.lower(F.substring("p_type", 1, 3))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", notes.model_name(asked, "F", "P").alias("model"))


@query("""with m as (select source, case when doc_id % 7 = 0 then 'é' else '' end || 'n' || doc_id || '.md' as name, n_chars as mtime from documents),
  r as (select source, name, mtime, row_number() over (partition by source order by (name <> 'n' || 12 || '.md')::int, regexp_matches(name, '[^\\x00-\\x7F]')::int, mtime desc, length(name), lower(name)) as k from m) select source, name, mtime from r where k = 1""")
def publish_targets(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "é").otherwise(""), F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return notes.publish_target(table(spark, d, "documents").select("source", name.alias("name"), F.col("n_chars").alias("mtime")), "source", F.lit("n12.md"))


@query("""with h as (select md5(text) as k, 'a/' || doc_id as path from documents union all select md5(text), 'A/' || doc_id from documents where doc_id % 2 = 0 union all select 'key-' || source, 'a/' || doc_id from documents)
  select k, count(distinct lower(path)) as n, min(lower(path)) as first from h group by k""")
def note_index_matches(spark, d):
    """The multimap of a vault: paths by hash and by parent key, those that differ in case only once."""
    docs = table(spark, d, "documents")
    path = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("path")
    by_hash = docs.select(F.md5("text").alias("k"), path("a/")).unionByName(docs.where("doc_id % 2 = 0").select(F.md5("text").alias("k"), path("A/")))
    every = by_hash.unionByName(docs.select(F.concat(F.lit("key-"), "source").alias("k"), path("a/")))
    return every.select("k", F.lower("path").alias("p")).distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("p").alias("first"))


@query("""select source, arg_min(length(text) // 500, doc_id)::bigint as primary_pages, sum(length(text) // 500)::bigint as total_pages, sum(strlen(text))::bigint as total_bytes, arg_min(strlen(text), doc_id)::bigint as primary_bytes from documents group by source""")
def preflight_sums(spark, d):
    pages, size = F.floor(F.length("text") / 500), F.octet_length("text").cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.min_by(pages, "doc_id").alias("primary_pages"), F.sum(pages).alias("total_pages"), F.sum(size).alias("total_bytes"), F.min_by(size, "doc_id").alias("primary_bytes"))


@query("""select user_id, latest, n from (select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest, count(*) as n from events group by user_id having max(ts) <= timestamp '2024-01-30') order by latest, user_id limit 20""")
def archives_oldest_first(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at"), F.count("*").alias("n")).where("at <= timestamp '2024-01-30'")
    return by.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("latest"), "n").orderBy("latest", "user_id").limit(20)


@query("""select o_orderpriority as batch, count(*) as n, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'P') as pending, case when count(*) filter (o_orderstatus = 'F') > 0 then 1 when count(*) filter (o_orderstatus = 'P') > 0 then 200 else 0 end::int as exit_code from orders group by 1""")
def batch_outcomes(spark, d):
    """Counts of outcomes and the exit code: a failure outweighs what is pending."""
    failed, pending = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count("*").alias("n"), failed.alias("failed"), pending.alias("pending"), F.when(failed > 0, 1).when(pending > 0, 200).otherwise(0).alias("exit_code"))


@query("""select item_id, sha256(text) as quote_hash, (item_id % 6 <> 0) as holds from benchmark""")
def quote_hash_check(spark, d):
    claimed = F.when(F.col("item_id") % 6 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("quote_hash"), (F.sha2("text", 256) == claimed).alias("holds"))


@query("""select user_id from (select user_id, list_sort(list_distinct(list(event_type))) as a, list_sort(list_distinct(list(event_type) filter (value > 90))) as b from events group by user_id) where a is distinct from b""")
def claim_set_mismatch(spark, d):
    """Users whose two sets of types differ: the check of expected claims on both sides of a key."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("value") > 90, F.col("event_type")))).alias("b"))
    return by.where("a <> b").select("user_id")


@query("""with o as (select 'm' || (doc_id % 50) as file, source as paper from documents union all select 's' || (doc_id % 90), source from documents where doc_id % 4 = 0) select file, count(distinct paper) as n from o group by file having count(distinct paper) > 1""")
def file_ownership(spark, d):
    """Files that more than one paper claims, as main text or supplement."""
    docs = table(spark, d, "documents")
    main = docs.select(F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.col("source").alias("paper"))
    more = docs.where("doc_id % 4 = 0").select(F.concat(F.lit("s"), (F.col("doc_id") % 90).cast("string")).alias("file"), F.col("source").alias("paper"))
    return main.unionByName(more).groupBy("file").agg(F.count_distinct("paper").alias("n")).where("n > 1")


@query("""with a as (select distinct lang as v from documents), b as (select distinct case when n_nationkey % 2 = 0 then 'en' else lower(n_name) end as v from nation) select coalesce(a.v, b.v) as value, a.v is not null as in_enum from a full join b on a.v = b.v where a.v is null or b.v is null""")
def enum_template_difference(spark, d):
    """Values that only one side has."""
    a = table(spark, d, "documents").select(F.col("lang").alias("value")).distinct().withColumn("_a", F.lit(True))
    b = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise(F.lower("n_name")).alias("value")).distinct().withColumn("_b", F.lit(True))
    return a.join(b, "value", "full").where("_a is null or _b is null").select("value", F.col("_a").isNotNull().alias("in_enum"))


@query(f"""with h as (select q, label, vec_id, row_number() over (partition by q order by distance, vec_id) as rank from (select q, label, vec_id, {_COS.format(a="embedding", b="v")} as distance from embeddings, (select vec_id as q, embedding as v, label from embeddings where vec_id % 100 = 0) asked (q, v, label_q)))
  select vec_id, min(rank)::int as best_rank, count(*) as angles, string_agg(q::varchar, ',' order by q) as runs from h where rank <= 10 group by vec_id""")
def angle_pool(spark, d):
    """Every hundredth vector as an angle: the hits of all in one pool, each with its best rank and the angles that found it."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    hits = search.nearest(rows, asked, 10, "q", "v", itself=True)
    return hits.groupBy("vec_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("angles"), F.array_join(F.array_sort(F.collect_set("q")), ",").alias("runs"))


@query(f"""with p as (select label from ({_topk(_L2, 1, 5)})) select vec_id, rank, round(1 - distance, 4) as score from (select vec_id, distance, row_number() over (order by distance, vec_id)::int as rank from
  (select vec_id, {_COS.format(a="embedding", b="q")} as distance from embeddings join p using (label), (select embedding as q from embeddings where vec_id = 5))) where rank <= 3""")
def paper_to_note(spark, d):
    """Source first: the nearest chunk's key, then the three nearest notes of that key."""
    rows, q = table(spark, d, "embeddings"), _query_vector(spark, d, 5)
    key = search.top_k(rows, q, 1, search.squared_l2).select("label")
    best = search.top_k(rows.join(F.broadcast(key), "label"), q, 3, search.cosine_distance)
    return best.select("vec_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


@query("""with s as (select l_suppkey, sum(l_quantity) as cand, sum(l_quantity) filter (l_returnflag <> 'R') as base from lineitem group by 1)
  select l_suppkey, round(least(1, coalesce(base, 0) / cand), 6) as efficiency, coalesce(base, 0) / cand >= 0.7 as passes from s""")
def efficiency_gate(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("cand"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)).alias("base"))
    ratio = F.col("base") / F.col("cand")
    return by.select("l_suppkey", F.round(F.least(F.lit(1.0), ratio), 6).alias("efficiency"), (ratio >= 0.7).alias("passes"))


@query("""select count(*) filter (p is null) as bad, count(*) filter (p is not null) as good, min(k) as least from (select try_cast(props as json) as p, try_cast(json_extract_string(try_cast(props as json), '$.k') as bigint) as k from (select case when event_id % 10 = 0 then 'x' || props else props end as props from events))""")
def json_lines_scan(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("value"))
    rows = json_lines(lines, "k long")
    return rows.agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.col("error").isNull()).alias("good"), F.min("record.k").alias("least"))


@query("""with q as (select conv_id, turn, case when role = 'user' then text end as a from conversations) select conv_id, string_agg(case when turn >= 4 then 'late' else substring(a, 1, 12) end, '|' order by turn) as log from q where a is not null group by conv_id""")
def query_log_render(spark, d):
    """A session's queries as one line: excerpts in turn, later ones as a mark."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(F.col("turn") >= 4, "late").otherwise(F.substring("text", 1, 12)).alias("part"))
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("parts"))
    return by.select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "|").alias("log"))


@query("""select event_type, strftime(ts, 'ql-%Y%m%d-%H%M%S-') || upper(substring(md5(event_id::varchar), 1, 6)) as log_id, strftime(ts, '%Y-%m') as month, event_id from events""")
def log_ids(spark, d):
    short = F.upper(F.substring(F.md5(F.col("event_id").cast("string")), 1, 6))
    return table(spark, d, "events").select("event_type", F.concat(F.date_format("ts", "'ql-'yyyyMMdd-HHmmss-"), short).alias("log_id"), F.date_format("ts", "yyyy-MM").alias("month"), "event_id")


@query("""select track, count(*) as n, round(avg(x), 6) as mean from (select ['pdf', 'gold', 'generated', 'oracle'][label % 4 + 1] as track, embedding[1]::double as x from embeddings) group by track""")
def evaluation_tracks(spark, d):
    track = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "gold", "generated", "oracle")]), (F.col("label") % 4 + 1).cast("int"))
    return table(spark, d, "embeddings").groupBy(track.alias("track")).agg(F.count("*").alias("n"), F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("mean"))


@query("""select value, count(*) as n_lines from (select md5(text) as value from documents) group by value having count(*) > 1""")
def duplicate_ledger_lines(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("value")).agg(F.count("*").alias("n_lines")).where("n_lines > 1")


@query("""select doc_id, md5(case when trim(split_part(t, '.', 2), ' ' || chr(10)) = '' then t else trim(split_part(t, '.', 2), ' ' || chr(10)) end) as effective from (select doc_id, coalesce(text, '') as t from documents)""")
def effective_query(spark, d):
    """The second sentence of a text overrides the first, an empty one does not."""
    second = F.regexp_replace(F.split_part("text", F.lit("."), F.lit(2)), "^[ \n]+|[ \n]+$", "")
    return whole(table(spark, d, "documents"), "text").select("doc_id", F.md5(F.coalesce(F.nullif(second, F.lit("")), F.col("text"))).alias("effective"))


@query(f"""with t as (select doc_id, {_TOKENS} as t from documents), b as (select item_id, list_distinct({_TOKENS}) as q from benchmark),
  p as (select item_id, doc_id, count(*) as n_both from (select doc_id, unnest(list_distinct(t)) as w from t) a join (select item_id, unnest(q) as w, len(q) as n from b) c using (w) group by item_id, doc_id)
  select item_id, doc_id, round(n_both / len(q), 4) as overlap from p join b using (item_id) where n_both >= 0.9 * len(q)""")
def evidence_token_overlap(spark, d):
    """Documents that hold nine tenths of a quote's tokens; only its rarest tokens look for them."""
    found = search.token_overlap(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"), "doc_id", "item_id")
    return found.select("item_id", "doc_id", F.round(F.col("both") / F.col("n"), 4).alias("overlap"))


@query("""select doc_id, length(substring(trim(text, ' '), 1, 2000))::int as chars, length(trim(text, ' ')) > 2000 as truncated from documents""")
def text_blocks(spark, d):
    clean = F.trim("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.substring(clean, 1, 2000)).alias("chars"), (F.length(clean) > 2000).alias("truncated"))


@query("""select conv_id, count(*) as pages, sum(length(text))::bigint as chars from conversations where turn < 3 group by conv_id""")
def first_pages(spark, d):
    return table(spark, d, "conversations").where("turn < 3").groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""select doc_id, not (regexp_matches(p, '^([A-Za-z]:)?[\\\\/]') or regexp_matches(p, '(^|[\\\\/])\\.\\.([\\\\/]|$)')) as safe from
  (select doc_id, replace(replace(replace(replace(text, '.', '/..'), ' ', '/'), ',', '..'), chr(10), chr(92)) as p from documents)""")
def artifact_paths(spark, d):
    """Paths cut from texts: words are folders, commas and full stops become dots, line breaks backslashes."""
    p = F.col("text")
    for old, new in ((".", "/.."), (" ", "/"), (",", ".."), ("\n", "\\")):
        p = F.replace(p, F.lit(old), F.lit(new))
    return table(spark, d, "documents").select("doc_id", (~(p.rlike(r"^([A-Za-z]:)?[\\/]") | p.rlike(r"(^|[\\/])\.\.([\\/]|$)"))).alias("safe"))
