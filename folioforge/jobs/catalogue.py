"""The queries over the driver's tables. Each has its SQL in catalogue_sql.py where SQL can say it.

The tables stand in for a library: documents are extracted texts and notes, source a paper's key, embeddings stored
vectors, benchmark quotes, labels judgments, conversations sessions, events logs, and lineitem, orders and customer
attachments, items and parents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity, text
from ..operators import dedup, evaluation, index, routing, search
from ..sources.tables import ledger_last_wins, ledger_set, shared_folder, table, whole
from ..streaming.incremental import incremental_chunks, sessions


def chunk_fixed_window(spark, d):
    rows = text.chunk_rows(table(spark, d, "documents").select("doc_id", "source", "text"))
    digest = identity.file_hash(F.col("source"))
    return rows.select(identity.chunk_id(digest, identity.file_hash(F.col("doc_id").cast("string")), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "chunk_start", F.md5("chunk").alias("chunk_md5"))


def chunk_stats_by_source(spark, d):
    rows = text.chunk_rows(table(spark, d, "documents").select("doc_id", "source", "text"))
    by = rows.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"), F.max(F.col("chunk_start") + F.length("chunk")).alias("covered"))
    return by.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.round(F.avg("n"), 4).alias("chunks_a_doc"), F.round(F.sum("chars") / F.sum("covered") - 1, 4).alias("repeated"))


def chunk_overlap_variants(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = None
    for size, step in ((800, 700), (800, 400), (1600, 1400)):
        rows = text.chunk_rows(docs, size=size, step=step).agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars")).select(F.lit(size).alias("size"), F.lit(step).alias("step"), "n_chunks", "n_chars")
        out = rows if out is None else out.unionByName(rows)
    return out


def truncate_last_references(spark, d):
    """Every third document gets two headings, so that the last one is where it is cut."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    given = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nReferences\n"), F.substring("text", 1, 50), F.lit("\nBIBLIOGRAPHY \nend"))).otherwise(F.col("text"))
    cut = text.without_references(given)
    return docs.select("doc_id", F.length(cut).alias("kept_chars"), F.md5(cut).alias("kept_md5"))


def page_join_null_safe(spark, d):
    """Turns are pages; the empty assistant pages are null."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("page"))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "page"))).alias("p"))
    return pages.select("conv_id", F.md5(text.joined_pages(F.transform("p", lambda x: x["page"]))).alias("text_md5"))


def file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", identity.file_hash(F.col("text")).alias("file_hash"), identity.note_id(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("note_id"))


def _groups(spark, d):
    """Files of a paper: documents of one source and block of five ids."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 5).cast("string")).alias("grp"), "doc_id", F.concat(F.lit("/Lib/"), "source", F.lit("/P"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), identity.file_hash(F.col("text")).alias("digest"))


def combined_hashes(spark, d):
    return identity.combined_hashes(_groups(spark, d), "grp")


def neighbour_ids(spark, d):
    rows = chunk_fixed_window(spark, d)
    before, after = identity.neighbour_ids(F.col("chunk_id"))
    return rows.select("chunk_id", before.alias("prev_id"), after.alias("next_id"))


def group_dedup_keep_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    return dedup.keep_first(rows, "signature", "doc_id").select("doc_id", "copies")


def _done(spark, d):
    """Hashes of labelled documents: with a path where quality is 1, else from the history ledger."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select(F.sha2("text", 256).alias("digest"), F.when(F.col("quality") == 1, F.concat(F.lit("notes/"), F.col("doc_id").cast("string"))).alias("path"))
    return rows


def dedup_priority_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    done = _done(spark, d)
    vault, ledger = done.where("path is not null"), done.select("digest", F.lit(None).cast("string").alias("path"))
    return dedup.priority_lookup(docs, "digest", [("vault", vault, "path"), ("ledger", ledger, "path")]).select("doc_id", "source_kind", "path")


def prefilter_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedup.prefilter(docs, _done(spark, d), "digest")[0].select("doc_id")


def prefilter_reasons(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedup.prefilter(docs, _done(spark, d), "digest")[1].groupBy("reason").agg(F.count("*").alias("n"))


def _ledger_lines(spark, d):
    """Note ledger lines: each labelled document once, toxic ones without a digest, low quality ones with a stale one, later lines overriding."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    first = rows.select((F.col("doc_id") * 2).alias("seq"), F.concat(name, F.lit("\told")).alias("line"))
    second = rows.where("quality = 1 or toxic = 1").select((F.col("doc_id") * 2 + 1).alias("seq"), F.when(F.col("toxic") == 1, name).otherwise(F.concat(name, F.lit("\t"), F.md5("text"))).alias("line"))
    return first.unionByName(second)


def ingest_plan(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    files = docs.select(name.alias("name"), F.md5("text").alias("digest"))
    present = table(spark, d, "labels").where("doc_id % 7 <> 0").select(name.alias("name"))
    return dedup.ingest_plan(files, ledger_last_wins(_ledger_lines(spark, d)), present).groupBy("action").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def ledger_audit(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    notes = docs.select(F.md5("text").alias("value"))
    lines = docs.join(labels, "doc_id").select(F.concat(F.lit(" "), F.md5("text"), F.lit(" ")).alias("value")).unionByName(labels.where("toxic = 1").select(F.md5(F.col("doc_id").cast("string")).alias("value")))
    return dedup.ledger_audit(notes, ledger_set(lines)).groupBy("state").agg(F.count("*").alias("n"))


def ledger_alias_rewrite(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("legacy"), F.sha2("text", 256).alias("stable"))
    ledger = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("legacy")).otherwise(F.col("stable")).alias("value"), F.col("doc_id").alias("seq"))
    return dedup.alias_rewrite(ledger, docs.where("doc_id % 4 = 0").select(F.col("legacy").alias("old"), F.col("stable").alias("new")))


def upsert_notes(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("digest"), F.lit(1).alias("version"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("digest"), F.lit(2).alias("version"))
    return index.upsert(old, new, "doc_id")


def replace_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    old = text.chunk_rows(docs).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))
    new = text.chunk_rows(docs.where("doc_id % 5 = 0"), size=400, step=400).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))
    return index.replace_by_path(old, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("digest").alias("least_digest"))


def group_commit(spark, d):
    files = _groups(spark, d).join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return index.completed_groups(files, "grp", F.coalesce(F.col("toxic") == 1, F.lit(False)), F.floor(F.col("n") / 700)).select("grp", F.col("n_chunks").cast("long").alias("n_chunks"))


def _query_vector(spark, d, vec_id=0):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q_embedding"))


def notes_topk_cosine(spark, d):
    best = search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 5, search.cosine_distance)
    return best.select("vec_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


def notes_topk_filtered(spark, d):
    best = search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 5, search.cosine_distance, F.col("label") == 3)
    return best.select("vec_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


def papers_topk_l2(spark, d):
    best = search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d, 7), 3, search.squared_l2)
    return best.select("vec_id", "rank", F.round("distance", 4).alias("distance"))


def papers_filter_precedence(spark, d):
    """A group of 0 is a filter too, and a file name beside it is not looked at."""
    where = search.one_predicate(None, 0, "ignored", columns=("parent_key", "label", "filename"))
    best = search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d, 7), 3, search.squared_l2, where)
    return best.select("vec_id", "label", "rank", F.round("distance", 4).alias("distance"))


def _asked(rows):
    """The queries of a search: every vector whose id is divisible by 100."""
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def _nearest(rows, asked, k):
    return search.nearest(rows, asked, k)


def topk_per_query(spark, d):
    """Every hundredth vector against all others."""
    rows = table(spark, d, "embeddings")
    return _nearest(rows, _asked(rows), 5).select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


def hash_embed_topk(spark, d):
    """All items against all documents."""
    docs = search.hash_vectors(table(spark, d, "documents"), "doc_id", "text")
    items = search.hash_vectors(table(spark, d, "benchmark"), "item_id", "text")
    return search.dense_top_k(docs, "doc_id", items, "item_id", 5).select("item_id", "doc_id", "rank", "score")


def context_stitch(spark, d):
    rows = search.stitched(text.chunk_rows(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    return rows.select("doc_id", "chunk_index", F.md5("context").alias("context_md5"))


def note_to_paper_drilldown(spark, d):
    """Notes first: the five nearest vectors; then for each label found its three nearest chunks' vectors by squared distance."""
    rows, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    keys = search.top_k(rows, q, 5, search.cosine_distance).select("label").distinct()
    papers = rows.join(F.broadcast(keys), "label").crossJoin(F.broadcast(q)).withColumn("distance", search.squared_l2(F.col("embedding"), F.col("q_embedding")))
    return search.ranked(papers, "label", [F.col("distance"), F.col("vec_id")], 3).select("label", "vec_id", "rank", F.round("distance", 4).alias("distance"))


def timeline_by_year(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("year")


def si_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 5 != 0).alias("is_si"), F.length("text").alias("n"))
    return search.ranked(docs, "source", [F.desc("is_si"), F.col("n"), F.col("doc_id")], 5, "place").select("source", "doc_id", "is_si", "place")


def _bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def lexical_bm25(spark, d):
    scored = _bm25(spark, d).withColumn("score", F.round("score", 4))
    return search.ranked(scored, "item_id", [F.desc("score"), F.col("doc_id")], 10).select("item_id", "doc_id", "rank", "score")


def rrf_hybrid(spark, d):
    lexical = lexical_bm25(spark, d)
    return search.reciprocal_rank_fusion([lexical, hash_embed_topk(spark, d)], ["item_id", "doc_id"]).select("item_id", "doc_id", F.round("rrf", 6).alias("rrf"), "n_lists")


def evidence_containment(spark, d):
    """Quotes that a document holds word for word."""
    return search.containing(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"), "doc_id", "item_id")


def first_hit_gain(spark, d):
    hits = evidence_containment(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    return evaluation.first_gain(hits, "item_id", "item_id").groupBy("item_id").agg(F.sum("gain").alias("gain"), F.count("*").alias("hits"))


def _judged(spark, d):
    """The first ten of each query; a hit of the query's label is relevant, one whose id is a multiple of nine unjudged."""
    rows = table(spark, d, "embeddings")
    asked = _asked(rows)
    hits = _nearest(rows, asked, 10).withColumn("relevance", F.when(F.col("vec_id") % 9 != 0, (F.col("label") == F.col("q_label")).cast("int")))
    relevant = rows.groupBy("label").agg(F.count("*").alias("n_relevant")).join(asked.select("query_id", "q_label"), F.col("label") == F.col("q_label")).select("query_id", "n_relevant", F.col("q_label").alias("domain"))
    return hits, relevant


def retrieval_metrics(spark, d):
    hits, relevant = _judged(spark, d)
    return evaluation.retrieval_metrics(hits, relevant.drop("domain"), "query_id").select("query_id", "hits", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("dcg", 6).alias("dcg"), "judged")


def macro_average(spark, d):
    hits, relevant = _judged(spark, d)
    scores = evaluation.retrieval_metrics(hits, relevant.drop("domain"), "query_id").join(relevant, "query_id")
    return evaluation.macro_average(scores, "domain", "mrr").select(F.round("macro", 6).alias("macro"), "domains")


def agreement_kappa(spark, d):
    return evaluation.weighted_kappa(table(spark, d, "labels"), "quality", "toxic").select(F.round("kappa", 6).alias("kappa"), "n")


def bootstrap_ci(spark, d):
    """The mean difference between a user's purchases and clicks, users resampled a thousand times."""
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    pairs = table(spark, d, "events").groupBy("user_id").agg(of("purchase").alias("a"), of("click").alias("b")).where("a is not null and b is not null")
    return evaluation.bootstrap_interval(pairs, "user_id", "a", "b").select(*[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


def fk_orphans(spark, d):
    docs, labels, orders, lines, customers = (table(spark, d, t) for t in ("documents", "labels", "orders", "lineitem", "customer"))
    return evaluation.orphans(labels, docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("p")), "doc_id", "p", "label_document").unionByName(evaluation.orphans(lines, orders.select("o_orderkey"), "l_orderkey", "o_orderkey", "line_order")).unionByName(evaluation.orphans(orders, customers.where("c_custkey % 100 <> 0").select("c_custkey"), "o_custkey", "c_custkey", "order_customer"))


def duplicate_ids(spark, d):
    return evaluation.duplicates(table(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


def partition_overlap(spark, d):
    """Texts that two partitions share, partitions by doc_id; there should be none but copies make some."""
    docs = table(spark, d, "documents").select(F.md5("text").alias("digest"), F.element_at(F.array(F.lit("D20"), F.lit("V20"), F.lit("H60")), (F.col("doc_id") % 3 + 1).cast("int")).alias("part"))
    return docs.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("part")), "+").alias("parts"), F.count_distinct("part").alias("n")).where("n > 1").select("digest", "parts")


def quota_check(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_distinct("source").alias("n_sources")).where("n_good >= 20")


def attachment_parent_join(spark, d):
    lines, orders, customers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    rows = lines.where(F.col("l_returnflag").isin("R", "A")).join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return rows.groupBy("c_custkey").agg(F.count("*").alias("n_files"), F.count_distinct("o_orderkey").alias("n_items"), F.min("l_linenumber").alias("first_line"))


def parent_key_fallback(spark, d):
    """The key by the exact name, else by the least key whose name ends with the number, taken out of the name first so that the join is on equality."""
    customers, suppliers = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    asked = suppliers.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.regexp_replace("s_name", "Supplier", "Customer")).otherwise(F.regexp_extract("s_name", "[0-9]+$", 0)).alias("wanted"))
    exact = asked.join(customers, asked.wanted == customers.c_name).select("s_suppkey", F.col("c_custkey").alias("exact"))
    numbered = customers.select("c_custkey", F.regexp_extract("c_name", "[0-9]+$", 0).alias("wanted"))
    loose = asked.join(exact, "s_suppkey", "left_anti").join(numbered, "wanted").groupBy("s_suppkey").agg(F.min("c_custkey").alias("loose"))
    return asked.join(exact, "s_suppkey", "left").join(loose, "s_suppkey", "left").select("s_suppkey", F.coalesce("exact", "loose").alias("parent_key"))


def attachment_since_or(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).where((F.col("l_shipdate") >= "1998-01-01") | (F.col("o_orderdate") >= "1998-01-01"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def limit_before_anti(spark, d):
    """The limit comes before the prefilter: of the first hundred documents, those not yet labelled."""
    first = table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)
    return first.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def route_model(spark, d):
    docs = table(spark, d, "documents")
    pages = F.floor(F.length("text") / 500).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("article", "review", "textbook", "letter")]), (F.col("doc_id") % 4 + 1).cast("int"))
    override = F.when(F.col("text").startswith("The "), "given-model")
    model, reason = routing.route(pages, pages * 2, kind, F.col("text").startswith("La"), F.lower("source").contains("a") & (F.length("text") > 5000), override)
    return docs.select("doc_id", model.alias("model"), reason.alias("reason"))


def fallback_trigger(spark, d):
    """Candidate counts from a text's long words, template and scope from its first words, domain and signal from language and length."""
    docs = table(spark, d, "documents")
    n = lambda p: F.size(F.regexp_extract_all(F.col("text"), F.lit(p), 0))
    first = F.lower(F.substring("text", 1, 1))
    why = routing.fallback(
        F.when(n("[A-Za-z]{13,}") > 2, 1).otherwise(0), F.when(n("[0-9]{4,}") > 0, 1).otherwise(0), F.when(n("[A-Za-z]{11,12}") > 1, 2).otherwise(0), F.when(first == "t", "generic-research-note").otherwise("std"),
        F.when(F.col("lang") == "de", "other").otherwise("chem"), F.when(F.col("text").startswith("La"), "other").otherwise("x"), F.when(F.length("text") < 400, "weak").otherwise("strong"),
    )
    return docs.select("doc_id", F.coalesce(why, F.lit("candidate tags already populated")).alias("reason"))


def split_plan(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", routing.split_parts(F.octet_length("text"), F.ceil(F.length("text") / 500), 2000, 10).alias("parts"))


def seed_term_grounding(spark, d):
    docs = whole(table(spark, d, "documents"), "text")
    words = F.split("text", r"[ \n]+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    return docs.select("doc_id", text.grounded(last, F.col("text")).alias("last_grounded"), text.grounded(first, F.col("text")).alias("first_grounded"))


def slug_language_title(spark, d):
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", text.slug(F.col("text")).alias("slug"), text.language_hint(F.col("text")).alias("hint"), text.session_title(F.col("text"), F.lit("query")).alias("title"))


def _notes(spark, d):
    docs = table(spark, d, "documents")
    block = text.frontmatter([("title_en", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 30)), ("doc_id", F.col("doc_id").cast("string")), ("journal", F.concat(F.col("source"), F.lit(": a")))])
    return docs.select("doc_id", F.concat(block, F.lit("\n"), F.col("text")).alias("content"))


def frontmatter_render(spark, d):
    return _notes(spark, d).select("doc_id", F.md5("content").alias("content_md5"))


def frontmatter_parse(spark, d):
    block, body = text.frontmatter_parts(F.col("content"))
    return _notes(spark, d).select("doc_id", text.frontmatter_value(block, "doc_id").alias("parsed_id"), text.frontmatter_value(block, "journal").alias("journal"), F.md5(body).alias("body_md5"))


def note_validation(spark, d):
    notes = _notes(spark, d).withColumn("content", F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit("\nwarnings: x"))).otherwise(F.col("content")))
    front = F.col("content").startswith("---\n") & F.col("content").contains("\n---\n")
    body = F.length(F.trim(F.substring_index("content", "\n---\n\n", -1))) > 0
    forbidden = F.filter(F.array(*[F.lit(x) for x in ("tag_review_status:", "candidate_needed:", "candidate_needed_raw_terms:", "routing_evidence:", "warnings:", "body_evidence_targets:")]), lambda x: F.col("content").contains(x))
    return notes.select("doc_id", front.alias("front"), body.alias("body"), F.size(forbidden).alias("n_forbidden"), (front & body & (F.size(forbidden) == 0)).alias("ready"))


def query_log_idempotent(spark, d):
    events = table(spark, d, "events")
    first = events.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.min("event_id").alias("event_id"))
    return first.groupBy("month").agg(F.count("*").alias("n_logs"), F.min("event_id").alias("first_event"))


def session_runs(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max_by("role", "turn").alias("last_role"))


def pending_runs(spark, d):
    events = table(spark, d, "events")
    filled = events.where("event_type = 'purchase' and value > 120").select("user_id").distinct()
    newest = events.join(filled, "user_id", "left_anti").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return newest


def archive_rollup(spark, d):
    events = table(spark, d, "events")
    by = events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("latest"))
    return by.select("user_id", "n", "total", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


def index_status(spark, d):
    return index.status(table(spark, d, "embeddings"), 64)


def compare_by_group(spark, d):
    best = search.top_k(table(spark, d, "embeddings"), _query_vector(spark, d, 3), 10, search.cosine_distance)
    return best.groupBy("label").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("vec_id").cast("string"), 9, "0"))), ",").alias("ids"))


def public_hits(spark, d):
    """Only what may be shown of a hit, and an error for an id of another form."""
    hits = notes_topk_cosine(spark, d).select(F.concat(F.lit("paper-"), F.col("vec_id").cast("string")).alias("paper_id"), "rank", "score")
    checked = F.when(F.col("paper_id").rlike("^[a-z0-9][a-z0-9._-]{0,127}$"), F.col("paper_id")).otherwise(F.raise_error(F.lit("bad id")))
    return hits.select(checked.alias("paper_id"), "rank", "score")


def stream_incremental_index(spark, d):
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    source = f"{d}/documents.parquet" if not d.endswith("/") else f"{d}documents.parquet"
    rows = incremental_chunks(spark, f"{source}*", docs.schema, f"{run}/index", f"{run}/ledger")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def user_sessions(spark, d):
    return sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = [
    chunk_fixed_window, chunk_stats_by_source, chunk_overlap_variants, truncate_last_references, page_join_null_safe, file_hash, combined_hashes, neighbour_ids,
    group_dedup_keep_first, dedup_priority_lookup, prefilter_anti, prefilter_reasons, ingest_plan, ledger_audit, ledger_alias_rewrite, upsert_notes, replace_chunks, group_commit,
    notes_topk_cosine, notes_topk_filtered, papers_topk_l2, papers_filter_precedence, topk_per_query, hash_embed_topk, context_stitch, note_to_paper_drilldown, timeline_by_year, compare_by_group, si_first,
    lexical_bm25, rrf_hybrid, evidence_containment, first_hit_gain, retrieval_metrics, macro_average, agreement_kappa, bootstrap_ci, fk_orphans, duplicate_ids, partition_overlap, quota_check,
    attachment_parent_join, parent_key_fallback, attachment_since_or, limit_before_anti, route_model, fallback_trigger, split_plan, seed_term_grounding, slug_language_title,
    frontmatter_render, frontmatter_parse, note_validation, public_hits, query_log_idempotent, session_runs, pending_runs, archive_rollup, index_status, stream_incremental_index, user_sessions,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
