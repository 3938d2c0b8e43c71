"""Queries of chunkers, planners, schema checks, agreement, release gates and the context cache; their SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import schema, text
from ..operators import chunking, context, evaluation, routing
from ..operators.evaluation import poisson_edges
from ..sources.tables import shared_folder, table
from .catalogue_sql import _chunks
from .notes_catalogue import query


def sectioned(spark, d):
    """Documents as Markdown: sentences as paragraphs, those of one word as headings, of two as headings below, and some as captions."""
    t = F.regexp_replace("text", r"\. ", ".\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^(\S+\.)$", "# $1"), r"(?m)^(\S+ \S+\.)$", "## $1")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(t, r"(?m)^(?=Th|Ei|El|Le)", "Table 7: ").alias("text"))


@query()
def chunk_sections(spark, d):
    """Chunks within sections, with their headings' path and their span."""
    return chunking.section_chunks(sectioned(spark, d), target=800, most=1200).withColumn("chunk", F.md5("chunk"))


@query()
def chunk_captions(spark, d):
    """Chunks within sections, with the captions next to their paragraphs."""
    rows = chunking.bound_chunks(sectioned(spark, d), target=800, most=1200)
    return rows.select("doc_id", "chunk_index", "section_path", "start", "stop", F.size("captions").alias("n_captions"), F.md5(F.to_json("captions")).alias("captions"))


@query("""with recursive pg as (select l_suppkey as file, floor(l_extendedprice)::bigint as bytes, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, floor(l_extendedprice)) as page from lineitem),
  cum as (select file, page, sum(bytes) over (partition by file order by page)::bigint as upto from pg union all select distinct file, 0, 0 from pg),
  f as (select file, max(page) as n, max(upto) as size from cum group by file),
  s as (select file, n, greatest(1, least(50, ceil(n / greatest(1, ceil(size / 400000.0), ceil(n / 50.0)))))::bigint as span from f),
  c as (select a.file, a.page as start, max(w) as own from (select cum.file, page, upto, unnest(list_transform(range(7), lambda k: greatest(1, least(span, n - page) // (1 << k)))) as w from cum join s using (file) where page < n) a
    join cum b on a.file = b.file and b.page = a.page + w where b.upto - a.upto <= 400000 group by all),
  parts as (select file, 0 as part_index, 0::bigint as start from s union all select p.file, part_index + 1, p.start + own from parts p join c on p.file = c.file and p.start = c.start join s on p.file = s.file where p.start + own < n),
  cuts as (select p.file, part_index, p.start, own, bool_or(own is null) over (partition by p.file) as bad from parts p left join c on p.file = c.file and p.start = c.start)
  select t.file, (case when bad then 0 else part_index end)::int as part_index, (t.start + 1)::int as page_start, (t.start + coalesce(own, 1))::int as page_end, (b.upto - a.upto)::bigint as bytes, case when bad then 'oversize_pdf' end as reason
  from cuts t join cum a on t.file = a.file and a.page = t.start join cum b on t.file = b.file and b.page = t.start + coalesce(own, 1) where not bad or own is null""")
def split_plan_halving(spark, d):
    """Suppliers as files, their lines as pages: parts of 50 pages and 400,000 bytes at most."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.struct("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("n")).alias("p"))
    files = lines.groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("p")).select("file", F.col("p.n").alias("pages"))
    return routing.planned_parts(files, "file", 400_000, 50)


RECORD = {
    "type": "OBJECT", "required": ["id", "lang", "stats"],
    "properties": {"id": {"type": "INTEGER"}, "lang": {"type": "STRING", "nullable": True, "enum": ["en", "de", "fr", "und"]}, "tags": {"type": "ARRAY", "items": {"type": "STRING"}},
                   "stats": {"type": "OBJECT", "required": ["n", "ok"], "properties": {"n": {"type": "INTEGER"}, "ok": {"type": "BOOLEAN"}}}},
}
_RECORD = """case when doc_id % 17 = 0 then 'x{' when doc_id % 19 = 0 then '[1]' else '{"id": ' || doc_id || case when doc_id % 23 = 0 then '' else ', "lang": ' || case doc_id % 7 when 0 then 'null' when 1 then '5' else '"' || coalesce(lang, 'und') || '"' end end || ', "tags": [' ||
  case doc_id % 5 when 0 then '"a", 3' when 1 then '' else '"x", "y"' end || '], "stats": {"n": ' || case when doc_id % 11 = 0 then '"many"' when doc_id % 11 = 1 then '1.5' else coalesce(cast(n_chars as string), '0') end || case when doc_id % 13 = 0 then '' else ', "ok": true' end || '}}' end"""


@query(f"""with r as (select doc_id, {_RECORD} as j from documents)
  select doc_id, case when not json_valid(j) then 'not JSON' when json_type(j) <> 'OBJECT' then 'Field root must be a JSON object.' when json_type(j, '$.lang') is null then 'Missing required field: lang'
    when json_type(j, '$.lang') not in ('NULL', 'VARCHAR') then 'Field root.lang must be a string.' when json_type(j, '$.lang') = 'VARCHAR' and json_extract_string(j, '$.lang') not in ('en', 'de', 'fr', 'und') then 'Field root.lang must be one of [''en'', ''de'', ''fr'', ''und''].'
    when json_type(j, '$.tags[1]') not in ('VARCHAR') then 'Field root.tags[1] must be a string.' when json_type(j, '$.stats.ok') is null then 'Missing required field: ok' when json_type(j, '$.stats.n') not in ('UBIGINT', 'BIGINT') then 'Field root.stats.n must be an integer.' end as fault from r""")
def schema_faults(spark, d):
    """The first fault of each document's record by a nested schema."""
    return table(spark, d, "documents").select("doc_id", schema.json_fault(F.expr(_RECORD), RECORD).alias("fault"))


_ALPHA = """r as (select user_id * 100 + day(ts) as u, least(3, floor(value / 60))::bigint as v from events where value is not null and event_type <> 'error'),
  g as (select u, v, count(*) as n from r group by all), m as (select u, sum(n) as m from g group by u having sum(n) > 1),
  o as (select a.v as c, b.v as k, sum(a.n * (b.n - (a.v = b.v)::int) / (m - 1)::double) as o from g a join g b using (u) join m using (u) group by all),
  n as (select c, sum(o) as n from o group by c), x as (select a.c, b.c as k, a.n as nc, b.n as nk, (select sum(n) from n where c between least(a.c, b.c) and greatest(a.c, b.c)) - (a.n + b.n) / 2 as w from n a, n b)"""


@query(f"""with {_ALPHA} select round(1 - ((select sum(m) from m) - 1) * sum(coalesce(o, 0) * w * w) filter (x.c <> x.k) / sum(nc * nk * w * w) filter (x.c <> x.k), 6) as alpha, (select sum(m) from m)::bigint as n_values, (select count(*) from m) as n_units
  from x left join o on x.c = o.c and x.k = o.k""")
def agreement_alpha(spark, d):
    """Events of one user and day as assessments of one unit, their values as grades from 0 to 3."""
    rows = table(spark, d, "events").where("event_type <> 'error'").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("unit"), F.least(F.lit(3), F.floor(F.col("value") / 60)).alias("grade"))
    return evaluation.krippendorff_alpha(rows, "unit", "grade").withColumn("alpha", F.round("alpha", 6))


_TRIAL = """l_linenumber::int as experiment, l_returnflag as domain, l_suppkey as cluster, month(l_shipdate) as slice, l_discount::double as primary_base,
  l_discount::double * (0.87 + 0.07 * l_linenumber) - case when l_linenumber = 6 and month(l_shipdate) = 1 then 0.05 else 0 end as primary_candidate, l_tax::double as guard_base,
  l_tax::double - case when l_linenumber = 5 then 0.03 else 0 end as guard_candidate, l_quantity::double as ms_base, l_quantity::double * case when l_linenumber = 7 then 2 else 1.2 end as ms_candidate"""
_GATES = f"""q as (select {_TRIAL} from lineitem), s as (select experiment, domain, cluster, sum(primary_candidate - primary_base) as d, count(*) as n from q group by all),
  u as (select *, ('0x' || substring(md5(cluster || '|' || sample || '|7'), 1, 8))::bigint::double / 4294967296 as u from s, (select unnest(range(1000)) as sample)),
  w as (select experiment, domain, sample, sum(k * d) / nullif(sum(k * n), 0) as d from (select *, {" + ".join(f"(u >= {e!r})::int" for e in poisson_edges())} as k from u) group by all),
  i as (select experiment, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from (select experiment, sample, avg(d) as d from w group by all) group by experiment),
  a as (select experiment, avg(b) as base, avg(d) as delta, avg(g) as guard_drop from (select experiment, domain, avg(primary_base) as b, avg(primary_candidate - primary_base) as d, avg(guard_base - guard_candidate) as g from q group by all) group by experiment),
  z as (select experiment, max(s) as slice_drop from (select experiment, slice, avg(primary_base - primary_candidate) as s from q group by all) group by experiment),
  p as (select experiment, quantile_cont(ms_base, 0.95) as p95_base, quantile_cont(ms_candidate, 0.95) as p95_candidate from q group by experiment),
  t as (select *, delta >= case when base = 0 then 0.05 else 0.05 * base end and low > 0 as primary_ok, guard_drop <= 0.02 as guard_ok, slice_drop <= 0.02 as slices_ok, p95_candidate <= 1.5 * p95_base as latency_ok from i join a using (experiment) join z using (experiment) join p using (experiment))"""


@query(f"""with {_GATES} select experiment, round(low, 6) as low, round(high, 6) as high, round(base, 6) as base, round(delta, 6) as delta, round(guard_drop, 6) as guard_drop, round(slice_drop, 6) as slice_drop, round(p95_base, 4) as p95_base, round(p95_candidate, 4) as p95_candidate,
  primary_ok, guard_ok, slices_ok, latency_ok, case when not (primary_ok and guard_ok) then 'reject' when slices_ok and latency_ok then 'ship' else 'owner' end as decision from t""")
def release_gates(spark, d):
    """Line numbers as experiments over orders' lines, with a gate that fails for each reason."""
    rows = table(spark, d, "lineitem").select(*[F.expr(x) for x in _spark_trial()])
    told = evaluation.release_gates(rows, "experiment", "domain", "cluster", "slice")
    digits = {"low": 6, "high": 6, "base": 6, "delta": 6, "guard_drop": 6, "slice_drop": 6, "p95_base": 4, "p95_candidate": 4}
    return told.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _spark_trial():
    moved = "cast(l_discount as double) * (cast(0.87 as double) + cast(0.07 as double) * l_linenumber)"
    return ["cast(l_linenumber as int) as experiment", "l_returnflag as domain", "l_suppkey as cluster", "month(l_shipdate) as slice", "cast(l_discount as double) as primary_base",
            f"{moved} - case when l_linenumber = 6 and month(l_shipdate) = 1 then 0.05D else 0D end as primary_candidate", "cast(l_tax as double) as guard_base",
            "cast(l_tax as double) - case when l_linenumber = 5 then 0.03D else 0D end as guard_candidate", "cast(l_quantity as double) as ms_base", "cast(l_quantity as double) * case when l_linenumber = 7 then 2D else 1.2D end as ms_candidate"]


@query(f"""with c as (select doc_id, chunk, text, source from ({_chunks(keep="doc_id, text, source")})), h as (select distinct md5(text) as t, md5(chunk) as k from c where doc_id % 3 <> 0),
  o as (select md5(text) as t, min(coalesce(source, '-')) as origin from documents group by 1)
  select doc_id, count(*) as n_chunks, count(*) filter (h.t is not null) as n_hits, min(md5(origin || ': ' || substring(chunk, 1, 40))) as least from c join o on o.t = md5(text) left join h on h.t = md5(text) and h.k = md5(chunk) group by doc_id""")
def context_cache(spark, d):
    """Contexts of two thirds of the documents' chunks are made and kept; then all are asked for, and only the others are made. A hit is a chunk of a text that was there before."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("document_hash"))
    first = docs.groupBy("document_hash").agg(F.min(F.coalesce("source", F.lit("-"))).alias("origin"))
    chunks = text.chunk_rows(docs.join(first, "document_hash"))
    make = lambda misses: misses.withColumn("context", F.concat("origin", F.lit(": "), F.substring("chunk", 1, 40)))
    cache = context.store(spark, f"{shared_folder(spark)}/contexts-{uuid.uuid4().hex}")
    context.with_context(chunks.where("doc_id % 3 <> 0"), cache, "place this chunk", "m1", make, "v1")
    told = context.with_context(chunks, cache, "place this chunk", "m1", make, "v2")
    return told.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if("hit").alias("n_hits"), F.min(F.md5("context")).alias("least"))
