"""Queries of a library's upkeep: lookups, workflows over the index, ledgers, validation, the query log; their SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes, text
from ..operators import dedup, evaluation, library, routing, search
from ..sources.tables import checkpoint, live_note, table, whole
from .catalogue import _asked, _groups, _nearest
from .catalogue_sql import _COS, _GROUPS, _L2, _TOKENS
from .notes_catalogue import query

_ASKED = "asked as (select vec_id as query_id, embedding as q, label as q_label from embeddings where vec_id % 100 = 0)"
_D = _COS.format(a="embedding", b="q")


@query("""with r as (select doc_id as request_id, case when lang = 'en' then source end as k, 'doc-' || doc_id || '.md' as f from documents where doc_id % 100 = 0),
  n as (select doc_id as note_id, source, 'doc-' || doc_id || '.md' as f, text, row_number() over (partition by source order by doc_id)::int as place from documents)
  select request_id, note_id, place, md5(substring(text, 1, 500) || chr(10) || '...') as content_md5 from r join n on k = source where place <= 5
  union all select request_id, note_id, 1, md5(substring(text, 1, 500) || chr(10) || '...') from r join n using (f) where k is null""")
def get_note(spark, d):
    """Every hundredth document is asked for: by its key if it is English, else by its path's file name; summaries of five notes at most."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    own = docs.select(F.col("doc_id").alias("note_id"), F.col("source").alias("parent_key"), name.alias("source_file"), F.md5(F.concat(F.substring("text", 1, 500), F.lit("\n..."))).alias("content"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("request_id"), F.when(F.col("lang") == "en", F.col("source")).alias("parent_key"), F.concat(F.lit("/vault/"), "lang", F.lit("/"), name).alias("source"))
    return library.get_notes(own, asked).withColumnRenamed("content", "content_md5")


@query(f"""with {_ASKED}, one as (select query_id, any_value(q) as q, arg_min(label, (distance, vec_id)) as key from (select query_id, q, vec_id, label, {_D} as distance from embeddings, asked where vec_id <> query_id) group by query_id)
  select query_id, vec_id, rank, round(1 - distance, 4) as score from (select query_id, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id)::int as rank from (select query_id, vec_id, {_D} as distance from embeddings join one on label = key where vec_id <> query_id)) where rank <= 3""")
def known_paper(spark, d):
    """The nearest note gives the key, then the three nearest notes of that key."""
    rows = table(spark, d, "embeddings")
    keyed = checkpoint(_nearest(rows, _asked(rows), 1).select("query_id", F.col("label").alias("key")))
    asked = _asked(rows).join(keyed, "query_id").select("query_id", "q", "key")
    return search.nearest(rows, asked, 3, on=("label", "key")).select("query_id", "vec_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


@query(f"""with {_ASKED}, one as (select query_id, any_value(q) as q, arg_min(label, (distance, vec_id)) as key, arg_min(vec_id, (distance, vec_id)) as note from (select query_id, q, vec_id, label, {_D} as distance from embeddings, asked where vec_id <> query_id) group by query_id)
  select query_id, note, md5(text) as note_md5, string_agg(vec_id::varchar, ',' order by rank) as papers from (select query_id, note, vec_id, row_number() over (partition by query_id order by distance, vec_id) as rank from
    (select query_id, note, vec_id, {_L2.format(a="embedding", b="q")} as distance from embeddings join one on label = key where vec_id <> query_id)) left join documents on doc_id = note where rank <= 5 group by query_id, note, text""")
def full_read(spark, d):
    """The nearest note in full, and its paper's five nearest chunks by squared distance."""
    rows = table(spark, d, "embeddings")
    one = checkpoint(_nearest(rows, _asked(rows), 1).select("query_id", F.col("label").alias("key"), F.col("vec_id").alias("note")))
    asked = _asked(rows).join(one, "query_id").select("query_id", "q", "key", "note")
    best = search.nearest(rows, asked, 5, on=("label", "key"), squared=True)
    listed = best.groupBy("query_id", "note").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))
    whole = listed.join(table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.md5("text").alias("note_md5")), "note", "left")
    return whole.select("query_id", "note", "note_md5", F.array_join(F.transform("l", lambda x: x["vec_id"].cast("string")), ",").alias("papers"))


_TOP10 = f"{_ASKED}, h as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from (select query_id, vec_id, {_D} as distance from embeddings, asked where vec_id <> query_id)) where rank <= 10)"


@query(f"with {_TOP10} select query_id, vec_id, 1990 + n_chars % 35 as year, row_number() over (partition by query_id order by n_chars % 35, rank)::int as place from h join documents on doc_id = vec_id")
def retrieval_timeline(spark, d):
    """The ten nearest notes of each query by year, the year being that of the note."""
    rows = table(spark, d, "embeddings")
    years = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), (F.lit(1990) + F.col("n_chars") % 35).alias("year"))
    return search.ranked(_nearest(rows, _asked(rows), 10).join(years, "vec_id"), "query_id", [F.col("year"), F.col("rank")], 10, "place").select("query_id", "vec_id", "year", "place")


@query(f"with {_TOP10} select query_id, vec_id, is_si, place from (select query_id, vec_id, lang <> 'en' as is_si, row_number() over (partition by query_id order by lang <> 'en' desc, distance, vec_id)::int as place from h join documents on doc_id = vec_id)")
def retrieval_methods(spark, d):
    """The ten nearest chunks of each query, supplements first."""
    rows = table(spark, d, "embeddings")
    si = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("lang") != "en").alias("is_si"))
    return search.ranked(_nearest(rows, _asked(rows), 10).join(si, "vec_id"), "query_id", [F.desc("is_si"), F.col("distance"), F.col("vec_id")], 10, "place").select("query_id", "vec_id", "is_si", "place")


@query(f"with {_TOP10}, o as (select query_id, vec_id, len(list_intersect(list_distinct({_TOKENS.replace('text', 'a.text')}), list_distinct({_TOKENS.replace('text', 'b.text')}))) as shared, rank from h join documents a on a.doc_id = vec_id join documents b on b.doc_id = query_id) select query_id, vec_id, shared::int as shared, place from (select *, row_number() over (partition by query_id order by shared desc, rank)::int as place from o) where place <= 5")
def rerank(spark, d):
    """The ten nearest again, by the number of tokens that their texts share with the query's text: five stay."""
    rows, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("vec_id"), F.array_distinct(search.tokens(F.col("text"))).alias("a"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_distinct(search.tokens(F.col("text"))).alias("b"))
    hits = _nearest(rows, _asked(rows), 10).select("query_id", "vec_id", "rank").join(asked, "query_id").join(own, "vec_id")
    return search.ranked(hits.withColumn("shared", F.size(F.array_intersect("a", "b"))), "query_id", [F.desc("shared"), F.col("rank")], 5, "place").select("query_id", "vec_id", "shared", "place")


@query(f"with {_ASKED} select query_id, vec_id, rank from (select query_id, vec_id, row_number() over (partition by query_id order by distance, vec_id)::int as rank from (select query_id, vec_id, {_D} as distance from embeddings join documents on doc_id = vec_id, asked where vec_id <> query_id and label = q_label and lang = 'en' and n_chars > 500)) where rank <= 3")
def filtered_search(spark, d):
    """Filters that hold together: key, main text only, and length."""
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").where("lang = 'en' and n_chars > 500").select("doc_id"), F.col("vec_id") == F.col("doc_id")).drop("doc_id")
    score = lambda pairs: pairs.where("label = q_label and vec_id <> query_id").withColumn("distance", search.cosine_distance(F.col("embedding"), F.col("q")))
    return search.against_all(rows, _asked(table(spark, d, "embeddings")), "query_id", score, 3, [F.col("distance"), F.col("vec_id")]).select("query_id", "vec_id", "rank")


_HITS = f"""{_TOP10}, g as (select query_id, e.vec_id, rank, case when e.label = a.label then 2 - (e.vec_id % 2) else 0 end as rel from h join embeddings e using (vec_id) join embeddings a on a.vec_id = query_id),
  r as (select a.vec_id as query_id, list(2 - (e.vec_id % 2) order by 2 - (e.vec_id % 2) desc)[1:10] as best, count(*) as n from embeddings a join embeddings e on a.label = e.label and a.vec_id <> e.vec_id where a.vec_id % 100 = 0 group by 1)"""


@query(f"""with {_HITS}, m as (select query_id, sum((pow(2.0, rel) - 1) / log2(rank + 1.0)) as dcg, count(*) filter (rel > 0 and rank <= 5) as h5, count(*) filter (rel > 0) as h10 from g group by query_id)
  select query_id, round(dcg / list_sum(list_transform(range(1, len(best) + 1), lambda i: (pow(2.0, best[i]) - 1) / log2(i + 1.0))), 6) as ndcg, round(h5 / n, 6) as recall_5, h10 >= least(n, 10) as complete from m join r using (query_id)""")
def graded_metrics(spark, d):
    """nDCG at 10 against the ideal order, recall at 5, and whether all that could be found was: a vector of the query's label has grade 1 or 2 by its id."""
    rows = table(spark, d, "embeddings")
    asked, grade = _asked(rows), 2 - F.col("vec_id") % 2
    hits = _nearest(rows, asked, 10).withColumn("rel", F.when(F.col("label") == F.col("q_label"), grade).otherwise(0))
    by_label = rows.groupBy("label", grade.alias("grade")).agg(F.count("*").alias("n"))
    ideal = asked.join(by_label, F.col("label") == F.col("q_label")).withColumn("n", F.col("n") - (F.col("grade") == 2 - F.col("query_id") % 2).cast("int"))
    ideal = ideal.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("grade") == 2, F.col("n")).otherwise(0)).alias("n2"))
    place = F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int"))
    best = F.aggregate(place, F.lit(0.0), lambda s, i: s + (F.pow(F.lit(2.0), F.when(i <= F.col("n2"), 2).otherwise(1)) - 1) / F.log2(i + 1.0))
    found = hits.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count_if((F.col("rel") > 0) & (F.col("rank") <= 5)).alias("h5"), F.count_if(F.col("rel") > 0).alias("h10"))
    return found.join(ideal, "query_id").select("query_id", F.round(F.col("dcg") / best, 6).alias("ndcg"), F.round(F.col("h5") / F.col("n"), 6).alias("recall_5"), (F.col("h10") >= F.least("n", F.lit(10))).alias("complete"))


@query(f"with {_TOP10}, p as (select distinct h.query_id, h.vec_id, l.doc_id is not null as judged from h left join labels l on l.doc_id = h.vec_id) select query_id, count(*) as pooled, round(avg(judged::int), 6) as coverage from p group by query_id")
def pool_coverage(spark, d):
    """The share of each query's pool that has a judgment."""
    rows = table(spark, d, "embeddings")
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("judged")).distinct()
    return _nearest(rows, _asked(rows), 10).join(judged, "vec_id", "left").groupBy("query_id").agg(F.count("*").alias("pooled"), F.round(F.avg(F.coalesce("judged", F.lit(0))), 6).alias("coverage"))


@query(f"""with p as (select conv_id, arg_min(text, turn) as a, arg_max(text, turn) as b from (select * replace (coalesce(text, '') as text) from conversations) group by conv_id), t as (select conv_id, list_distinct({_TOKENS.replace('text', 'a')}) as a, list_distinct({_TOKENS.replace('text', 'b')}) as b from p)
  select conv_id, case when len(a) + len(b) = 0 then 1.0 else round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end as f1 from t""")
def span_f1(spark, d):
    """Token F1 of two readings: the first and the last turn of a conversation."""
    by = whole(table(spark, d, "conversations"), "text").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    a, b = (F.array_distinct(search.tokens(F.col(c))) for c in "ab")
    total = F.size(a) + F.size(b)
    return by.select("conv_id", F.when(total == 0, 1.0).otherwise(F.round(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(total, F.lit(0)), 6)).alias("f1"))


@query("""select o_orderkey, trim(arg_min(p_name, (l_linenumber, l_partkey))) as value from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where s_nationkey < 5 group by o_orderkey""")
def attribute_lookup(spark, d):
    """An item's attribute through four tables, those of one kind only, the first of several."""
    orders, lines, parts, fields = (table(spark, d, t) for t in ("orders", "lineitem", "part", "supplier"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(parts, lines.l_partkey == parts.p_partkey).join(fields.where("s_nationkey < 5"), lines.l_suppkey == fields.s_suppkey)
    return rows.groupBy("o_orderkey").agg(F.trim(F.min_by("p_name", F.struct("l_linenumber", "l_partkey"))).alias("value"))


@query("""select item_id, any_value(doc_id) as doc_id from documents d join benchmark b on contains(d.text, b.text) group by item_id having count(*) = 1""")
def run_mapping(spark, d):
    """Runs that map to exactly one paper, by a text that it alone holds."""
    found = search.containing(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"), "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("item_id", "doc_id")


@query("""select doc_id from documents where sha256(text) in (select sha256(text) from documents join labels using (doc_id) where quality = 1 union all select sha256(text) from documents where lang = 'fr')""")
def covers(spark, d):
    """Documents whose hash the ledger or the vault has."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    known = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select("digest").unionByName(docs.where("lang = 'fr'").select("digest"))
    return docs.join(known, "digest", "left_semi").select("doc_id")


_FIVE = """x as (select doc_id, sha256(text) as h, md5(text) as l, source || '/' || (doc_id // 20) as k from documents), v as (select x.*, 'notes/' || doc_id as path from x join labels using (doc_id) where quality = 1 and toxic = 0), e as (select x.* from x join labels using (doc_id) where quality = 0)"""


@query(f"""with {_FIVE}, a as (select h, min(path) as p from v group by h), b as (select l, min(path) as p from v where doc_id % 2 = 0 group by l), c as (select k, min(path) as p from v group by k)
  select doc_id, case when a.p is not null then 'vault hash' when b.p is not null then 'vault legacy hash' when c.p is not null then 'vault parent key' when h in (select h from e) then 'ledger hash' when l in (select l from e where doc_id % 3 = 0) then 'ledger legacy hash' end as source_kind, coalesce(a.p, b.p, c.p) as path
  from x left join a using (h) left join b using (l) left join c using (k)""")
def dedup_five_sources(spark, d):
    """Where a document is known from: the vault by hash, legacy hash or parent key, then the ledger by hash or legacy hash; the first decides."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.md5("text").alias("l"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 20).cast("string")).alias("k"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id")
    vault = labelled.where("quality = 1 and toxic = 0").withColumn("path", F.concat(F.lit("notes/"), F.col("doc_id").cast("string")))
    ledger = labelled.where("quality = 0").withColumn("path", F.lit(None).cast("string"))
    out, found = docs, None
    for i, (name, rows, key) in enumerate([("vault hash", vault, "h"), ("vault legacy hash", vault.where("doc_id % 2 = 0"), "l"), ("vault parent key", vault, "k"), ("ledger hash", ledger, "h"), ("ledger legacy hash", ledger.where("doc_id % 3 = 0"), "l")]):
        out = out.join(rows.groupBy(key).agg(F.min("path").alias(f"p{i}"), F.lit(True).alias(f"hit{i}")), key, "left")
        hit = F.when(F.col(f"hit{i}"), F.struct(F.lit(name).alias("kind"), F.col(f"p{i}").alias("path")))
        found = hit if found is None else F.coalesce(found, hit)
    return out.select("doc_id", found["kind"].alias("source_kind"), found["path"].alias("path"))


_MIG = f"""g as (select grp, sha256(string_agg(digest, '' order by digest)) as stable, sha256(string_agg(digest, '' order by path)) as legacy, count(*) as n, count(*) filter (digest < '08') as gone, min(doc_id) as least from ({_GROUPS}) group by grp),
  m as (select g.*, text, case when starts_with(text, 'A') then stable when length(text) > 200 then legacy end as current from g join documents on doc_id = least),
  s as (select grp, stable, legacy, current, case when text like 'B%' then 'skipped_no_frontmatter' when n <= 1 then 'skipped_single_pdf' when gone > 0 then 'skipped_missing_pdf' when current is null or current <> stable then 'changed' else 'already_stable' end as status from m)"""


def _migrated(spark, d):
    """Notes of document groups: the first text decides which hash is there and whether there is a block; files with a small digest are gone."""
    by = _groups(spark, d).groupBy("grp").agg(F.array_sort(F.collect_list("digest")).alias("by_digest"), F.array_sort(F.collect_list(F.struct(F.lower("path").alias("p"), "digest"))).alias("by_path"), F.min("doc_id").alias("doc_id"))
    stable = F.sha2(F.array_join("by_digest", ""), 256)
    legacy = F.sha2(F.array_join(F.transform("by_path", lambda x: x["digest"]), ""), 256)
    rows = by.withColumn("stable", stable).withColumn("legacy", legacy).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    notes = rows.select(F.col("grp").alias("note_id"), F.when(~F.col("text").startswith("B"), "block").alias("block"), F.when(F.col("text").startswith("A"), F.col("stable")).when(F.length("text") > 200, F.col("legacy")).alias("current"), "legacy", "stable", F.size("by_digest").alias("n_paths"), F.size(F.filter("by_digest", lambda x: x < "08")).alias("n_missing"))
    return library.hash_migration(notes)


@query(f"with {_MIG} select grp as note_id, status, case when status in ('changed', 'already_stable') then stable end as stable from s")
def hash_migration(spark, d):
    return _migrated(spark, d).select("note_id", "status", F.when(F.col("aliases").isNotNull(), F.col("stable")).alias("stable"))


@query(f"""with {_MIG}, a as (select * from s where status in ('changed', 'already_stable')), al as (select old, max(stable) as stable from (select current as old, stable from a union all select legacy, stable from a union all select stable, stable from a) where old is not null group by old),
  l as (select coalesce(legacy, '') as value, least as seq from g union all select sha256(text), doc_id + 1000000000 from documents where lang = 'de'), o as (select coalesce(al.stable, l.value) as value, min(seq) as seq from l left join al on old = value group by 1)
  select value, seq from o union all select distinct stable, null::bigint from a where stable not in (select value from o)""")
def migrated_ledger(spark, d):
    """The ledger of all groups' legacy hashes and some files' own after the migration, with the stable hashes that it lacks."""
    moved = checkpoint(_migrated(spark, d))
    first = _groups(spark, d).groupBy("grp").agg(F.min("doc_id").alias("seq"))
    lines = moved.join(first, moved.note_id == first.grp).select(F.col("legacy").alias("value"), "seq")
    more = table(spark, d, "documents").where("lang = 'de'").select(F.sha2("text", 256).alias("value"), (F.col("doc_id") + 1000000000).alias("seq"))
    return library.migrated_ledger(lines.unionByName(more), moved)


@query("""select distinct value from (select sha256(coalesce(text, '')) as value from documents where doc_id % 3 = 0 union all select sha256(coalesce(text, '')) from documents where lang = 'es')""")
def ledger_append(spark, d):
    """A ledger in which lines of two hashes were glued together, and more lines appended."""
    docs = whole(table(spark, d, "documents"), "text").select("doc_id", "lang", "source", F.sha2("text", 256).alias("value"))
    thirds = docs.where("doc_id % 3 = 0")
    glued = thirds.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias("value"))
    return library.ledger_append(glued, docs.where("lang = 'es'"))


@query("""with n as (select distinct md5(text) as v from documents where lang <> 'fr'), l as (select md5(text) as v, doc_id from documents join labels using (doc_id) union all select md5(doc_id::varchar), doc_id from labels where toxic = 1)
  select 'kept' as state, v as value from (select distinct v from l) where v in (select v from n) union all select 'ghost', v from (select distinct v from l) where v not in (select v from n)""")
def ledger_clean(spark, d):
    """The ledger rewritten to what notes bear out; the rest is set aside."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    lines = docs.join(labels, "doc_id").select(F.md5("text").alias("value")).unionByName(labels.where("toxic = 1").select(F.md5(F.col("doc_id").cast("string")).alias("value")))
    told = dedup.ledger_audit(docs.where("lang <> 'fr'").select(F.md5("text").alias("value")), lines)
    return told.where("state <> 'orphan'").select(F.when(F.col("state") == "valid", "kept").otherwise("ghost").alias("state"), "value")


@query("""select count(*) as n_lines, count(distinct md5(text)) as n_values, count(*) - count(distinct md5(text)) as n_repeated, count(*) filter (trim(text) = '') as n_blank from (select * replace (coalesce(text, '') as text) from documents)""")
def ledger_repeats(spark, d):
    docs = whole(table(spark, d, "documents"), "text")
    return docs.agg(F.count("*").alias("n_lines"), F.count_distinct(F.md5("text")).alias("n_values"), (F.count("*") - F.count_distinct(F.md5("text"))).alias("n_repeated"), F.count_if(F.trim("text") == "").alias("n_blank"))


_LEDGERS = r"""papers as (select 'p' || doc_id as paper_id, 'f' || substring(md5(text), 1, 12) as file_id, replace(replace(substring(text, 1, 30), ' ', '/'), '.', '..') as path from documents),
  evidence as (select 'e' || item_id as evidence_id, 'p' || (item_id * 7) as paper_id, 'f' || substring(md5(d.text), 1, 12) as file_id, b.text as quote, sha256(replace(b.text, chr(10), ' ')) as quote_hash, instr(b.text, ',') as char_start, instr(b.text, '.') as char_end, 'g' || (length(b.text) % 9) as group_id from benchmark b left join documents d on d.doc_id = item_id * 7),
  claims as (select 'c' || page_id as claim_id, 'p' || (length(html) % 2000) as paper_id, 'g' || (length(url) % 11) as group_id from pages),
  queries as (select 'q' || conv_id as query_id, 'c' || max(length(text)) as claim_id, 'g' || count(*) as group_id from conversations group by conv_id),
  answers as (select 'q' || conv_id as query_id, 'c' || max(length(text)) as claim_id from conversations where role <> 'system' group by conv_id having count(*) > 1 union all select 'q' || (item_id * 5), 'c1' from benchmark where item_id % 4 = 3),
  dq as (select 'q' || (doc_id // 2) as query_id, 'p' || doc_id as target_id from labels union all select 'q' || (doc_id // 2), 'p' || doc_id from labels where toxic = 1), eq as (select 'q' || (length(text) % 150) as query_id, 'e' || (item_id * 2) as target_id from benchmark),
  pools as (select 'q' || doc_id as query_id, case when toxic = 1 then 'evidence' else 'document' end as kind, case when toxic = 1 then 'e' else 'p' end || doc_id as target_id from labels where quality = 1)"""


@query(f"""with {_LEDGERS}, o as (select file_id, min(paper_id) as owner, count(distinct paper_id) as n from papers group by file_id), a as (select query_id, list_sort(list_distinct(list(claim_id))) as given from answers group by query_id)
  select 'manifest' as label, file_id as id, 'file of several papers' as code from o where n > 1
  union all select 'manifest', paper_id, 'unsafe path' from papers where regexp_matches(path, '^([A-Za-z]:)?[\\\\/]') or regexp_matches(path, '(^|[\\\\/])\\.\\.([\\\\/]|$)')
  union all select 'evidence', evidence_id, 'unknown paper' from evidence where paper_id not in (select paper_id from papers)
  union all select 'evidence', evidence_id, 'file of another paper' from evidence left join o using (file_id) where owner is null or owner <> paper_id
  union all select 'evidence', evidence_id, 'quote hash' from evidence where sha256(quote) <> quote_hash
  union all select 'evidence', evidence_id, 'empty span' from evidence where char_end <= char_start
  union all select 'claims', claim_id, 'unknown paper' from claims where paper_id not in (select paper_id from papers) union all select 'claims', claim_id, 'unknown group' from claims where group_id not in (select group_id from evidence)
  union all select 'queries', query_id, 'unknown claim' from queries where claim_id not in (select claim_id from claims) union all select 'queries', query_id, 'unknown group' from queries where group_id not in (select group_id from evidence)
  union all select 'queries', query_id, 'no answer' from queries where query_id not in (select query_id from a) union all select 'queries', query_id, 'claims differ' from queries join a using (query_id) where given <> [claim_id]
  union all select 'answers', query_id, 'unknown query' from a where query_id not in (select query_id from queries)
  union all select 'document_qrels', query_id, 'unknown query' from dq where query_id not in (select query_id from queries) union all select 'document_qrels', target_id, 'unknown target' from dq where target_id not in (select paper_id from papers)
  union all select 'document_qrels', query_id || ' ' || target_id, 'duplicate judgment' from dq group by query_id, target_id having count(*) > 1
  union all select 'evidence_qrels', query_id, 'unknown query' from eq where query_id not in (select query_id from queries) union all select 'evidence_qrels', target_id, 'unknown target' from eq where target_id not in (select evidence_id from evidence)
  union all select 'evidence_qrels', query_id || ' ' || target_id, 'duplicate judgment' from eq group by query_id, target_id having count(*) > 1
  union all select 'judgment_pools', query_id, 'unknown query' from pools where query_id not in (select query_id from queries)
  union all select 'judgment_pools', target_id, 'unknown document' from pools where kind = 'document' and target_id not in (select paper_id from papers) union all select 'judgment_pools', target_id, 'unknown evidence' from pools where kind = 'evidence' and target_id not in (select evidence_id from evidence)""")
def benchmark_errors(spark, d):
    """Every broken rule of ledgers made of the tables: documents are papers, benchmark items evidence, pages claims, conversations queries, labels judgments."""
    docs, items, pages, turns, labels = (table(spark, d, t) for t in ("documents", "benchmark", "pages", "conversations", "labels"))
    named = lambda p, c: F.concat(F.lit(p), (F.col(c) if isinstance(c, str) else c).cast("string"))
    file_id = F.concat(F.lit("f"), F.substring(F.md5("text"), 1, 12))
    path = F.replace(F.replace(F.substring("text", 1, 30), F.lit(" "), F.lit("/")), F.lit("."), F.lit(".."))
    papers = docs.select(named("p", "doc_id").alias("paper_id"), file_id.alias("file_id"), path.alias("artifact_path"))
    own = docs.select(named("p", "doc_id").alias("paper_id"), file_id.alias("file_id"))
    evidence = items.select(named("e", "item_id").alias("evidence_id"), named("p", F.col("item_id") * 7).alias("paper_id"), F.col("text").alias("quote"), F.sha2(F.replace("text", F.lit("\n"), F.lit(" ")), 256).alias("quote_hash"), F.instr("text", ",").alias("char_start"), F.instr("text", ".").alias("char_end"), named("g", F.length("text") % 9).alias("group_id")).join(own, "paper_id", "left")
    claims = pages.select(named("c", "page_id").alias("claim_id"), F.array(named("p", F.length("html") % 2000)).alias("paper_ids"), F.array(named("g", F.length("url") % 11)).alias("group_ids"))
    queries = turns.groupBy("conv_id").agg(F.max(F.length("text")).alias("m"), F.count("*").alias("n")).select(named("q", "conv_id").alias("query_id"), F.array(named("c", "m")).alias("claim_ids"), F.array(named("g", "n")).alias("group_ids"))
    answered = turns.where("role <> 'system'").groupBy("conv_id").agg(F.max(F.length("text")).alias("m"), F.count("*").alias("n")).where("n > 1").select(named("q", "conv_id").alias("query_id"), named("c", "m").alias("claim"))
    answers = answered.unionByName(items.where("item_id % 4 = 3").select(named("q", F.col("item_id") * 5).alias("query_id"), F.lit("c1").alias("claim"))).groupBy("query_id").agg(F.collect_set("claim").alias("claim_ids"))
    judged = labels.select(named("q", F.floor(F.col("doc_id") / 2)).alias("query_id"), named("p", "doc_id").alias("target_id"), "toxic")
    pools = labels.where("quality = 1").select(named("q", "doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "evidence").otherwise("document").alias("kind"), F.concat(F.when(F.col("toxic") == 1, "e").otherwise("p"), F.col("doc_id").cast("string")).alias("target_id"))
    document_qrels = judged.drop("toxic").unionByName(judged.where("toxic = 1").drop("toxic"))
    evidence_qrels = items.select(named("q", F.length("text") % 150).alias("query_id"), named("e", F.col("item_id") * 2).alias("target_id"))
    return library.validate(papers, evidence, claims, queries, answers, document_qrels, evidence_qrels, pools)


_MEMBERS = """members as (select ['d20', 'v20', 'h60'][length(text) % 3 + 1] as suite, 'paper' as kind, 'p' || doc_id as id from documents where n_chars % 5 = 0 union all select 's100', 'paper', 'p' || doc_id from documents where n_chars % 5 = 0 and lang <> 'es'
  union all select 's5', 'paper', 'p' || doc_id from documents where n_chars % 50 = 0 union all select 'v20', 'paper', 'p' || doc_id from documents where n_chars % 35 = 0
  union all select distinct case when conv_id % 2 = 0 then 'd20' else 'h60' end, 'query', 'q' || conv_id from conversations union all select distinct 's100', 'query', 'q' || conv_id from conversations where role = 'system')"""


def _members(spark, d):
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    row = lambda rows, suite, kind, name, c: rows.select((suite if not isinstance(suite, str) else F.lit(suite)).alias("suite"), F.lit(kind).alias("kind"), F.concat(F.lit(name), F.col(c).cast("string")).alias("id"))
    part = F.element_at(F.array(F.lit("d20"), F.lit("v20"), F.lit("h60")), (F.length("text") % 3 + 1).cast("int"))
    fifth = docs.where("n_chars % 5 = 0")
    return library.union([row(fifth, part, "paper", "p", "doc_id"), row(fifth.where("lang <> 'es'"), "s100", "paper", "p", "doc_id"), row(docs.where("n_chars % 50 = 0"), "s5", "paper", "p", "doc_id"), row(docs.where("n_chars % 35 = 0"), "v20", "paper", "p", "doc_id"), row(turns, F.when(F.col("conv_id") % 2 == 0, "d20").otherwise("h60"), "query", "q", "conv_id").distinct(), row(turns.where("role = 'system'"), "s100", "query", "q", "conv_id").distinct()])


@query(f"""with {_MEMBERS}, b as (select kind, id, list(distinct suite) as s from members group by kind, id), c as (select kind, id, list_contains(s, 's5') as s5, list_contains(s, 'd20') as d, list_contains(s, 'v20') as v, list_contains(s, 'h60') as h, list_contains(s, 's100') as u from b)
  select * from (select kind || ': s5 within d20' as rule, count(*) filter (s5 and not d) as n from c group by kind union all select kind || ': s100 is the union', count(*) filter (u <> (d or v or h)) from c group by kind
  union all select kind || ': d20 and v20 apart', count(*) filter (d and v) from c group by kind union all select kind || ': d20 and h60 apart', count(*) filter (d and h) from c group by kind union all select kind || ': v20 and h60 apart', count(*) filter (v and h) from c group by kind) where n > 0""")
def suite_union(spark, d):
    """Suites by length and language of texts: which rules of containment, separation and union they break."""
    return library.suite_errors(_members(spark, d))


_WANTED = ", ".join([f"('{s}', 'papers', {p}, false), ('{s}', 'queries', {q}, true)" for s, (p, q, _) in library.SUITES.items()] + [f"('{s}', 'domain {x}', {n}, false)" for s, (_, _, n) in library.SUITES.items() for x in ("en", "de", "fr", "es")])


@query(f"""with {_MEMBERS}, w(suite, rule, wanted, least) as (values {_WANTED}), f as (select suite, kind || 's' as rule, count(distinct id) as found from members group by all union all select suite, 'domain ' || lang, count(distinct id) from members join documents on id = 'p' || doc_id where kind = 'paper' group by all)
  select suite, rule, wanted::bigint as wanted, coalesce(found, 0)::bigint as found from w left join f using (suite, rule) where case when least then coalesce(found, 0) < wanted else coalesce(found, 0) <> wanted end""")
def release_quotas(spark, d):
    papers = table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("lang").alias("domain"))
    return library.release_errors(_members(spark, d), papers, ["en", "de", "fr", "es"])


_REQ = """r as (select conv_id * 1000 + turn as request_id, 'wf' || (turn % 3) as workflow_id, role as workflow_name, case when role = 'system' then 'unknown' when role = 'user' then ' completed ' else 'partial' end as status, case when length(text) > 40 then text else '' end as query, substring(text, 1, 10) as anchor_query, text as final_response_snapshot, md5(substring(text, 1, 25)) as idempotency_key, turn as created_at from (select * replace (coalesce(text, '') as text) from conversations)),
  c as (select *, case when trim(query) = '' or trim(anchor_query) = '' then 'missing: ' || array_to_string(list_filter([case when trim(query) = '' then 'query' end, case when trim(anchor_query) = '' then 'anchor_query' end, case when trim(final_response_snapshot) = '' then 'final_response_snapshot' end], lambda x: x is not null), ', ') when trim(status) not in ('completed', 'partial', 'failed') then 'invalid status' end as refused from r),
  f as (select idempotency_key, arg_min(request_id, (created_at, request_id)) as first from c where refused is null group by idempotency_key)"""


def _requests(spark, d):
    turns = whole(table(spark, d, "conversations"), "text")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat(F.lit("wf"), (F.col("turn") % 3).cast("string")).alias("workflow_id"), F.col("role").alias("workflow_name"), F.when(F.col("role") == "system", "unknown").when(F.col("role") == "user", " completed ").otherwise("partial").alias("status"), F.when(F.length("text") > 40, F.col("text")).otherwise("").alias("query"), F.substring("text", 1, 10).alias("anchor_query"), F.col("text").alias("final_response_snapshot"), F.md5(F.substring("text", 1, 25)).alias("idempotency_key"), F.col("turn").alias("created_at"))


@query(f"with {_REQ} select request_id, case when refused is not null then refused when first = request_id then 'created' else 'repeated' end as outcome, case when refused is null then first end as log_of from c left join f using (idempotency_key)")
def query_log_write(spark, d):
    """Turns as requests to log: refused where a field lacks or the status is unknown, written once for a key."""
    return library.logged(_requests(spark, d))


@query(f"with {_REQ}, w as (select distinct first from f) select idempotency_key, first as log_id, strftime(make_timestamp(1704067200000000 + first * 1000000), '%Y-%m') as month from f")
def query_log_registry(spark, d):
    """One row for each key that was logged: its log and the month of it."""
    rows = _requests(spark, d)
    told = library.logged(rows).where("outcome = 'created'").join(rows.select("request_id", "idempotency_key"), "request_id")
    return told.select("idempotency_key", F.col("request_id").alias("log_id"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("request_id")), "yyyy-MM").alias("month"))


@query("""with a as (select user_id as log_id, event_type as action, ts, json_extract_string(props, '$.k') as result from events where event_type <> 'view'), l as (select distinct user_id as log_id from events where event_type = 'purchase')
  select log_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || action || ': ' || coalesce(result, ''), chr(10) order by ts, action, result) as actions from a join l using (log_id) group by log_id""")
def query_log_actions(spark, d):
    """Actions appended to logs that exist, in order, one line each."""
    events = table(spark, d, "events")
    logs = events.where("event_type = 'purchase'").select("user_id").distinct()
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(": "), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    rows = events.where("event_type <> 'view'").join(logs, "user_id").select("user_id", "ts", "event_type", line.alias("line"))
    listed = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type", "line"))).alias("l"))
    return listed.select(F.col("user_id").alias("log_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("actions"))


@query("""select conv_id, md5('# ' || substring(trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')), 1, 60) || chr(10) || chr(10) || '## Notes' || chr(10) || coalesce(string_agg('- ' || substring(trim(text, ' '), 1, 80), chr(10) order by turn) filter (role = 'user'), 'none') || chr(10) || chr(10) || '## Papers' || chr(10) || coalesce(string_agg('- ' || substring(trim(text, ' '), 1, 120), chr(10) order by turn) filter (role = 'assistant'), 'none')) as log_md5
  from (select * replace (coalesce(text, '') as text) from conversations) group by conv_id""")
def query_log_markdown(spark, d):
    """A session as Markdown: title, then excerpts of its note and paper hits, in order; a section without any says so."""
    rows = whole(table(spark, d, "conversations"), "text")
    kept = lambda role, n: F.array_join(F.transform(F.filter("l", lambda x: x["role"] == role), lambda x: F.concat(F.lit("- "), F.substring(F.trim(x["text"]), 1, n))), "\n")
    listed = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    part = lambda head, c: F.concat(F.lit(f"\n\n## {head}\n"), F.when(c == "", "none").otherwise(c))
    title = F.substring(F.trim(F.regexp_replace("first", r"\s+", " ")), 1, 60)
    return listed.select("conv_id", F.md5(F.concat(F.lit("# "), title, part("Notes", kept("user", 80)), part("Papers", kept("assistant", 120)))).alias("log_md5"))


_FIELDS = ("title_en", "journal", "keywords", "topic", "research_domain", "year", "scope_hint")


@query(r"""with w as (select doc_id, text, source, lang, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: regexp_matches(x, '^[A-Za-z]{5,}$')) as k, lower(source) as s from (select * replace (coalesce(text, '') as text, coalesce(lang, 'und') as lang, coalesce(source, 'none') as source) from documents))
  select doc_id, md5('---' || chr(10) || 'title_en: ' || """ + r"""case when t = '' then '''''' when regexp_matches(t, '^[0-9]+$') then t when regexp_matches(t, '[:#{}\[\],&*?|<>=!%@`\\]') then '''' || replace(t, '''', '''''') || '''' else t end || chr(10) || 'year: ' || (1990 + length(text) % 35) || chr(10) || 'journal: ' || source || chr(10)
    || case when len(k) = 0 then 'keywords: []' else 'keywords:' || chr(10) || array_to_string(list_transform(k, lambda x: '  - ' || x), chr(10)) end || chr(10) || 'research_domain: ' || lang || chr(10) || 'combined_hash: ' || sha256(text) || chr(10) || case when lang = 'de' then 'legacy_combined_hash: ' || md5(text) || chr(10) else '' end
    || 'pdf_0_name: ' || doc_id || '.pdf' || chr(10) || 'pdf_0_path: /lib/' || source || '/' || doc_id || '.pdf' || chr(10) || case when lang = 'en' then 'zotero_parent_key: ' || upper(substring(md5(source), 1, 8)) || chr(10) else '' end
    || 'tags: []' || chr(10) || 'candidate_tags_high: []' || chr(10) || 'candidate_tags_medium: []' || chr(10) || 'candidate_tags_low: []' || chr(10) || 'human_reviewed: 0' || chr(10) || '---') as note_md5 from (select *, substring(replace(text, chr(10), ' '), 1, 25) as t from w)""")
def note_render_full(spark, d):
    """A note's whole frontmatter in its fixed order: own fields (absent ones left out), hashes, files, key, empty tag lists and the review mark."""
    docs = whole(table(spark, d, "documents"))
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    words = F.filter(F.split(flat, " "), lambda x: x.rlike("^[A-Za-z]{5,}$"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    block = notes.full_frontmatter(
        {"title_en": F.substring(flat, 1, 25), "keywords": words, "year": (F.lit(1990) + F.length("text") % 35).cast("string"), "journal": F.col("source"), "research_domain": F.col("lang")},
        F.sha2("text", 256), F.when(F.col("lang") == "de", F.md5("text")), [F.concat(F.lit("/lib/"), "source", F.lit("/"), name)], F.when(F.col("lang") == "en", F.upper(F.substring(F.md5("source"), 1, 8))),
    )
    return docs.select("doc_id", F.md5(block).alias("note_md5"))


@query()
def abstract_normalize(spark, d):
    """All texts as abstracts on one line; null is empty. Its rules need patterns that SQL here lacks: the tests hold it against a plain version."""
    return table(spark, d, "documents").select("doc_id", F.md5(notes.one_line_abstract(F.col("text"))).alias("abstract_md5"))


@query(r"""with n as (select doc_id, lang, source, 'pdf_0_path: /home/' || source || '/a.pdf' || chr(10) || case when lang <> 'fr' then 'pdf_1_path: C:\\x\\b.pdf' || chr(10) else '' end || case when starts_with(text, 'T') then 'pdf_7_path: z' || chr(10) else '' end || case when starts_with(text, 'D') then 'log_path: C:/y' || chr(10) else '' end as c, text from (select * replace (coalesce(text, '') as text, coalesce(lang, 'und') as lang, coalesce(source, 'none') as source) from documents))
  select doc_id, case when starts_with(text, 'T') then 'no artifact' when lang = 'fr' then 'slots differ' when starts_with(text, 'D') then 'absolute path' else 'clean' end as state, md5('pdf_0_artifact_path: corpus/' || source || '/main.pdf' || chr(10) || case when lang <> 'fr' then 'pdf_1_artifact_path: corpus/' || source || '/si.pdf' || chr(10) else '' end || case when starts_with(text, 'T') then 'pdf_7_path: z' || chr(10) else '' end || case when starts_with(text, 'D') then 'log_path: C:/y' || chr(10) else '' end) as note_md5 from n""")
def path_sanitizer(spark, d):
    """Paths of a frozen note replaced by those of its artifacts, and whether all slots are covered and no absolute path is left."""
    docs = whole(table(spark, d, "documents"))
    line = lambda holds, x: F.when(holds, x).otherwise("")
    t = F.col("text")
    content = F.concat(F.lit("pdf_0_path: /home/"), "source", F.lit("/a.pdf\n"), line(F.col("lang") != "fr", "pdf_1_path: C:\\x\\b.pdf\n"), line(t.startswith("T"), "pdf_7_path: z\n"), line(t.startswith("D"), "log_path: C:/y\n"))
    state, clean = notes.sanitized(content, [F.concat(F.lit("corpus/"), "source", F.lit("/main.pdf")), F.concat(F.lit("corpus/"), "source", F.lit("/si.pdf"))])
    return docs.select("doc_id", state.alias("state"), F.md5(clean).alias("note_md5"))


@query(r"""with j as (select event_id, case when event_id % 7 = 0 then replace(props, '}', '') when event_type = 'view' then '  ' when event_type = 'click' then '{"k": "' || user_id || '"}' when event_type = 'error' then '{"kk": 1}' else props end as t from events)
  select event_id, trim(t) <> '' and json_valid(t) as filled, case when trim(t) = '' or not json_valid(t) then 'not an object' when json_type(t, '$.k') is null then 'missing k' when json_type(t, '$.k') not in ('UBIGINT', 'BIGINT') then 'k must be an integer' end as error from j""")
def schema_check(spark, d):
    """Outputs that are filled with JSON, and the first rule of their schema that they break."""
    raw = F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit("}"), F.lit(""))).when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "click", F.concat(F.lit('{"k": "'), F.col("user_id").cast("string"), F.lit('"}'))).when(F.col("event_type") == "error", '{"kk": 1}').otherwise(F.col("props"))
    filled, error = notes.checked_json(raw, {"k": "INTEGER"})
    return table(spark, d, "events").select("event_id", filled.alias("filled"), error.alias("error"))


@query(r"""select page_id, sha256('{"response_schema":"' || lower(split_part(url, '/', 4)) || '","system_prompt":"' || regexp_extract(url, '^[a-z]+') || '","temperature":0,"user_prompt":"' || regexp_replace(url, '[^a-z]+', ' ', 'g') || '"}') as digest, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '-') as slug,
  case when url not like '%/fr/%' then 'active-domain' when url like '%page=%' then 'field-neutral' else 'legacy-domain-mixed' end as scope, case when url like '%/fr/%' and url not like '%page=%' then 'blocked-domain-pack-mismatch' else 'eligible-for-human-review' end as promotion from (select * replace (coalesce(url, '') as url) from pages)""")
def frozen_notes(spark, d):
    """What a frozen fixture is named and judged by: the prompt's digest, a pack's slug, the scope of its rules and whether it may be promoted."""
    pages, url = whole(table(spark, d, "pages"), "url"), F.col("url")
    prompt = notes.prompt_digest(F.regexp_extract(url, "^[a-z]+", 0), F.regexp_replace(url, "[^a-z]+", " "), F.lower(F.split_part(url, F.lit("/"), F.lit(4))), "0")
    scope = F.when(~url.contains("/fr/"), "active-domain").when(url.contains("page="), "field-neutral").otherwise("legacy-domain-mixed")
    return pages.select("page_id", prompt.alias("digest"), notes.pack_slug(url).alias("slug"), scope.alias("scope"), F.when(scope == "legacy-domain-mixed", "blocked-domain-pack-mismatch").otherwise("eligible-for-human-review").alias("promotion"))


@query("""with f as (select source, doc_id, length(text) // 500 as pages, strlen(text) as size from (select * replace (coalesce(text, '') as text) from documents)), g as (select source, arg_min(pages, doc_id) as p, sum(pages) as t, sum(size) as s, bool_or(size > 20000) as parted from f group by source)
  select source, p::bigint as primary_pages, t::bigint as total_pages, s::bigint as total_bytes, 'flash' as profiler, case when p >= 30 or t >= 60 then 'pro' else 'flash' end as generator, parted as chunking_enabled from g""")
def model_plan(spark, d):
    """One record for each group of files: sizes, both models and whether a file has to be parted."""
    docs = whole(table(spark, d, "documents"), "text")
    files = docs.select("source", "doc_id", F.floor(F.length("text") / 500).alias("pages"), F.octet_length("text").cast("long").alias("size"))
    by = files.groupBy("source").agg(F.min_by("pages", "doc_id").alias("primary_pages"), F.sum("pages").alias("total_pages"), F.sum("size").alias("total_bytes"), F.bool_or(F.col("size") > 20000).alias("chunking_enabled"))
    model, _ = routing.route(F.col("primary_pages"), F.col("total_pages"), F.lit("article"), F.lit(False))
    return by.select("source", "primary_pages", "total_pages", "total_bytes", F.lit("flash").alias("profiler"), model.alias("generator"), "chunking_enabled")


@query(f"""with {_TOP10}, k as (select query_id, list(source order by rank) as l from h join documents on doc_id = vec_id group by query_id) select query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as keys from k""")
def collected_keys(spark, d):
    """The keys of a search's hits in the order of their ranks, each once."""
    rows = table(spark, d, "embeddings")
    hits = _nearest(rows, _asked(rows), 10).select("query_id", "vec_id", "rank").join(table(spark, d, "documents").select("doc_id", "source"), F.col("vec_id") == F.col("doc_id"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("l"))
    return listed.select("query_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["source"])), ",").alias("keys"))


@query("""select doc_id, length(substring(text, 1, 12000))::int as n_sent, md5(substring(text, 1, 12000)) as sent_md5, case when contains(lower(text), 'non_retryable_error[corrupt_pdf]') then true else false end as hopeless from (select * replace (coalesce(text, '') as text) from documents)""")
def embed_input(spark, d):
    """What of a text is sent to be embedded, and whether an error in it is one that another try can't mend."""
    sent = F.substring("text", 1, 12000)
    return whole(table(spark, d, "documents"), "text").select("doc_id", F.length(sent).alias("n_sent"), F.md5(sent).alias("sent_md5"), library.non_retryable(F.col("text")).alias("hopeless"))


@query("""select label, count(*) as n, min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim, case when count(*) = 0 then null when min(len(embedding)) <> 64 or max(len(embedding)) <> 64 then 'dimension differs' end as flag from embeddings group by label""")
def dim_guard(spark, d):
    """For each collection the sizes of its vectors, and a flag where they are not the model's."""
    n = F.size("embedding")
    by = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"))
    return by.withColumn("flag", F.when((F.col("min_dim") != 64) | (F.col("max_dim") != 64), "dimension differs"))


@query("""with p as (select doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) > 0), lambda x: length(x)) as l from documents)
  select doc_id, len(l) as paragraphs, coalesce(list_sum(l), 0)::bigint as chars, coalesce(list_max(l), 0)::int as longest from p""")
def paragraph_stats(spark, d):
    """Paragraphs that the packing chunker has to place; a text without any has zeros."""
    lengths = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), lambda x: F.length(x))
    rows = whole(table(spark, d, "documents"), "text").select("doc_id", lengths.alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("paragraphs"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x).alias("chars"), F.coalesce(F.array_max("l"), F.lit(0)).alias("longest"))


@query("""with recursive p as (select doc_id, x, length(x) as n, row_number() over (partition by doc_id order by k) as i from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents) where length(x) > 0),
  r as (select doc_id, i, 0 as chunk_index, n as held from p where i = 1
    union all select p.doc_id, p.i, case when held + 1 + p.n <= 800 then chunk_index else chunk_index + 1 end, case when held + 1 + p.n <= 800 then held + 1 + p.n else p.n end from r join p on p.doc_id = r.doc_id and p.i = r.i + 1)
  select doc_id, chunk_index::int as chunk_index, length(string_agg(x, chr(10) order by i))::int as chars, md5(string_agg(x, chr(10) order by i)) as chunk_md5 from r join p using (doc_id, i) group by doc_id, chunk_index""")
def paragraph_chunks(spark, d):
    """Whole paragraphs packed into chunks of 800 characters; tested against a loop too."""
    return text.packed_chunks(whole(table(spark, d, "documents"), "text").select("doc_id", "text")).select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("""with c as (select doc_id, chunk_index, chunk from (select doc_id, (s // 700)::int as chunk_index, substring(text, s + 1, 800) as chunk, length(text) - s as rest from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 700)) as s from documents)) where least(rest, 800) > 100),
  k as (select distinct md5(chunk) || md5(text) as key, 'In ' || lang || ': ' || substring(text, 1, 30) as prefix from c join documents using (doc_id))
  select doc_id, chunk_index, md5(prefix || chr(10) || chunk) as sent_md5 from c join documents using (doc_id) join k on key = md5(chunk) || md5(text) and prefix = 'In ' || lang || ': ' || substring(text, 1, 30)""")
def contextual_prefix(spark, d):
    """Chunks with a prefix that tells of their document, made once for each (chunk, document, language) and joined back; the chunk's own text stays as it is."""
    docs = table(spark, d, "documents")
    rows = text.chunk_rows(docs.select("doc_id", "lang", F.md5("text").alias("doc_key"), F.substring("text", 1, 30).alias("head"), "text")).withColumn("chunk_key", F.md5("chunk"))
    cache = rows.groupBy("chunk_key", "doc_key", "lang", "head").agg(F.concat(F.lit("In "), F.col("lang"), F.lit(": "), F.col("head")).alias("prefix"))
    return rows.join(cache.drop("head"), ["chunk_key", "doc_key", "lang"]).select("doc_id", "chunk_index", F.md5(F.concat("prefix", F.lit("\n"), "chunk")).alias("sent_md5"))


@query("""with f as (select l_orderkey, case l_linenumber % 3 when 0 then 'storage:f' || l_partkey || '.pdf' when 1 then 'attachments:sub/f' || l_partkey || '.PDF' else '/abs/g' || l_partkey || '.txt' end as path, case when l_returnflag = 'A' then 'application/pdf' else 'text/plain' end as mime, l_linenumber from lineitem where l_shipdate >= '1997-01-01'),
  k as (select l_orderkey, case when starts_with(path, 'storage:') then '/data/storage/' || lpad(l_orderkey::varchar, 8, '0') || '/' || replace(path, 'storage:', '') when starts_with(path, 'attachments:') then '/base/' || replace(path, 'attachments:', '') else path end as full_path from f where lower(path) like '%.pdf' or mime = 'application/pdf')
  select o_custkey as parent, count(*) as n, string_agg(full_path, '|' order by o_orderkey, full_path) as files from k join orders on o_orderkey = l_orderkey group by o_custkey""")
def attachment_groups(spark, d):
    """Files of each parent in order of item and path: PDF by name or type, recent ones, paths of all schemes resolved."""
    lines, orders = table(spark, d, "lineitem").where("l_shipdate >= '1997-01-01'"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    kind, part = F.col("l_linenumber") % 3, F.col("l_partkey").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("storage:f"), part, F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("attachments:sub/f"), part, F.lit(".PDF"))).otherwise(F.concat(F.lit("/abs/g"), part, F.lit(".txt")))
    rows = lines.select("l_orderkey", path.alias("path"), "l_returnflag").where(F.lower("path").like("%.pdf") | (F.col("l_returnflag") == "A"))
    full = notes.resolved_path(F.col("path"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), "/data", "/base")
    by = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", full.alias("f")))).alias("l"))
    return by.select("parent", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["f"]), "|").alias("files"))


@query(r"""with p as (select page_id, replace(url, 'http://', '') as rel from (select * replace (coalesce(url, '') as url) from pages)) select page_id, not (starts_with(rel, 'progress/gate_reports/') or len(list_filter(string_split(rel, '/'), lambda x: x in ('.claude', '.obsidian', '__pycache__', '.stfolder') or starts_with(x, '.tmp'))) > 0) as live from (select page_id, case when page_id % 9 = 0 then 'progress/gate_reports/' when page_id % 9 = 1 then '.tmpx/' else '' end || rel as rel from p)""")
def live_notes(spark, d):
    """Addresses as paths of a vault: which are live notes and not in its work folders."""
    n = F.col("page_id") % 9
    rel = F.concat(F.when(n == 0, "progress/gate_reports/").when(n == 1, ".tmpx/").otherwise(""), F.replace("url", F.lit("http://"), F.lit("")))
    return whole(table(spark, d, "pages"), "url").select("page_id", live_note(rel).alias("live"))


@query("""with i as (select source as key, lower('A/' || doc_id % 700) as path from documents), e as (select distinct lower('a/' || doc_id) as path from labels) select key, count(*) as n, min(path) as first from (select distinct key, path from i) join e using (path) group by key""")
def cached_index(spark, d):
    """A cached index with paths that are gone dropped and those that differ in case taken once."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    cached = docs.groupBy(F.col("source").alias("key")).agg(F.collect_list(F.concat(F.lit("A/"), (F.col("doc_id") % 700).cast("string"))).alias("paths"))
    there = labels.select(F.lower(F.concat(F.lit("a/"), F.col("doc_id").cast("string"))).alias("path")).distinct()
    return cached.select("key", F.explode("paths").alias("p")).select("key", F.lower("p").alias("path")).distinct().join(there, "path").groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query("""with s as (select lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) as suite_id, lower(substring(n_name, 1, 6)) || '.yaml' as file from nation) select suite_id, case when count(*) > 1 then 'duplicate id' when any_value(file) <> suite_id || '.yaml' then 'file name differs' end as error from s group by suite_id having count(*) > 1 or any_value(file) <> suite_id || '.yaml'""")
def config_scan(spark, d):
    """Suites and configurations whose id is there twice or is not their file's name."""
    rows = table(spark, d, "nation").select(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("suite_id"), F.concat(F.lower(F.substring("n_name", 1, 6)), F.lit(".yaml")).alias("file"))
    by = rows.groupBy("suite_id").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    error = F.when(F.col("n") > 1, "duplicate id").when(F.col("file") != F.concat("suite_id", F.lit(".yaml")), "file name differs")
    return by.select("suite_id", error.alias("error")).where("error is not null")


@query("""select o_orderstatus as status, case when o_orderstatus = 'F' then 'generation_failed' when o_orderstatus = 'O' then 'uploaded' else 'completed' end as archive, count(*) as n, max(o_orderkey) as newest from orders group by 1, 2""")
def archive_status(spark, d):
    """Archives by the status of their manifest."""
    s = F.col("o_orderstatus")
    archive = F.when(s == "F", "generation_failed").when(s == "O", "uploaded").otherwise("completed")
    return table(spark, d, "orders").groupBy(s.alias("status"), archive.alias("archive")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("""with n as (select doc_id, '---' || chr(13) || chr(10) || 'k: ' || source || chr(13) || chr(10) || '---' || case when lang = 'en' then '' else chr(10) end || text as c, text, source, lang from (select * replace (coalesce(text, '') as text, coalesce(lang, 'und') as lang, coalesce(source, 'none') as source) from documents))
  select doc_id, case when lang = 'en' then 'k: ' || source else 'k: ' || source end as block, md5(text) as body_md5 from n""")
def scanner_frontmatter(spark, d):
    """The scanner's reading of a block: either line end, and none needed after it."""
    docs = whole(table(spark, d, "documents"))
    content = F.concat(F.lit("---\r\nk: "), "source", F.lit("\r\n---"), F.when(F.col("lang") == "en", "").otherwise("\n"), "text")
    block, body = notes.scanner_frontmatter(content)
    return docs.select("doc_id", block.alias("block"), F.md5(body).alias("body_md5"))


@query("""with s as (select doc_id, case when length(text) < 300 then 'short' when lang is null then 'no language' when contains(text, '@') then 'mail' else 'ready' end as status from (select * replace (coalesce(text, '') as text) from documents)) select status, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, min(doc_id) as first from s group by status""")
def status_histogram(spark, d):
    """Documents by the first state that holds, with their share."""
    t = F.col("text")
    status = F.when(F.length(t) < 300, "short").when(F.col("lang").isNull(), "no language").when(t.contains("@"), "mail").otherwise("ready")
    by = whole(table(spark, d, "documents"), "text").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "first")
