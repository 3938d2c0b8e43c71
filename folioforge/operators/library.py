"""Upkeep of a library: note lookups, hash migration, ledgers, the query log, and one table of errors over benchmark ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import ranked

#: Marks of errors that another try can't mend, statuses of a logged query, and required fields of its record.
NON_RETRYABLE = ("non_retryable_error[corrupt_pdf]", "non_retryable_error[oversize_pdf]", "non_retryable_error[missing_pdf]")
REQUIRED = ("workflow_id", "workflow_name", "status", "query", "anchor_query", "final_response_snapshot", "idempotency_key")
#: Papers, least queries and papers of each domain of a released suite.
SUITES = {"s5": (5, 25, 1), "d20": (20, 100, 4), "v20": (20, 60, 4), "h60": (60, 140, 12), "s100": (100, 300, 20)}
PARTITIONS = ("d20", "v20", "h60")


def union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def get_notes(notes: DataFrame, requests: DataFrame, limit: int = 5) -> DataFrame:
    """(request_id, note_id, place, content) of requests (request_id, parent_key, source): notes (note_id, parent_key, source_file, content) of the key
    if one is given, else of the source's file name; the first `limit` by note_id. A key keeps its first notes before the join, so a large key costs no more."""
    def first(key, wanted):
        best = ranked(notes.where(F.col(key).isNotNull()), key, [F.col("note_id")], limit, "place").select(F.col(key).alias("_k"), "note_id", "place", "content")
        return wanted.join(best, "_k").select("request_id", "note_id", "place", "content")

    keyed = F.coalesce(F.col("parent_key"), F.lit("")) != ""
    by_key = requests.where(keyed).select("request_id", F.col("parent_key").alias("_k"))
    by_name = requests.where(~keyed).select("request_id", F.regexp_extract("source", r"[^/\\]*$", 0).alias("_k"))
    return first("parent_key", by_key).unionByName(first("source_file", by_name))


def hash_migration(notes: DataFrame) -> DataFrame:
    """notes (note_id, block, current, legacy, stable, n_paths, n_missing) with status and aliases: those without a block, with one file or with files that are gone are
    left; the others are changed or already stable."""
    status = (
        F.when(F.col("block").isNull(), "skipped_no_frontmatter").when(F.col("n_paths") <= 1, "skipped_single_pdf").when(F.col("n_missing") > 0, "skipped_missing_pdf")
        .when(F.col("current").isNull() | (F.col("current") != F.col("stable")), "changed").otherwise("already_stable")
    )
    known = F.array_distinct(F.array_compact(F.array("current", "legacy", "stable")))
    return notes.withColumn("status", status).withColumn("aliases", F.when(F.col("status").isin("changed", "already_stable"), known))


def migrated_ledger(lines: DataFrame, migrated: DataFrame) -> DataFrame:
    """(value, seq): ledger lines (value, seq) with aliases of migrated notes replaced, each value once at its first place; stable hashes that are lacking follow with seq null."""
    moved = migrated.where("aliases is not null").select(F.explode("aliases").alias("old"), "stable").groupBy("old").agg(F.max("stable").alias("stable"))
    own = lines.join(moved, lines.value == moved.old, "left").groupBy(F.coalesce("stable", "value").alias("value")).agg(F.min("seq").alias("seq"))
    more = migrated.where("aliases is not null").select(F.col("stable").alias("value")).distinct().join(own, "value", "left_anti")
    return own.unionByName(more.withColumn("seq", F.lit(None).cast("long")))


def ledger_append(ledger: DataFrame, added: DataFrame) -> DataFrame:
    """(value): the ledger's lines, glued ones of 64 digits each taken apart, and those added that it lacks; blank ones are nothing."""
    fixed = F.when(F.col("value").rlike("^([0-9a-f]{64}){2,}$"), F.regexp_extract_all("value", F.lit("[0-9a-f]{64}"), 0)).otherwise(F.array(F.trim("value")))
    return ledger.select(F.explode(fixed).alias("value")).unionByName(added.select(F.trim("value").alias("value"))).where("value <> ''").distinct()


def non_retryable(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__or__, [low.contains(m) for m in NON_RETRYABLE])


def logged(requests: DataFrame, allowed: tuple[str, ...] = ("completed", "partial", "failed")) -> DataFrame:
    """requests (the fields of REQUIRED, created_at) with outcome: why one is refused, created for the first of an idempotency key, else repeated with the log of the first."""
    lacking = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c) for c in REQUIRED]))
    checked = requests.withColumn("refused", F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).when(~F.trim("status").isin(*allowed), "invalid status"))
    firsts = checked.where("refused is null").groupBy("idempotency_key").agg(F.min(F.struct("created_at", "request_id")).alias("first"))
    told = checked.join(firsts, "idempotency_key", "left")
    first = told["first.request_id"]
    return told.select("request_id", F.when(F.col("refused").isNotNull(), F.col("refused")).when(first == F.col("request_id"), "created").otherwise("repeated").alias("outcome"), F.when(F.col("refused").isNull(), first).alias("log_of"))


def _lacks(rows: DataFrame, key: str, there: DataFrame, there_key: str, label: str, id_column: str, code: str) -> DataFrame:
    known = there.select(F.col(there_key).alias("_known")).distinct()
    return rows.join(known, F.col(key) == F.col("_known"), "left_anti").select(F.lit(label).alias("label"), F.col(id_column).alias("id"), F.lit(code).alias("code"))


def _wrong(rows: DataFrame, holds: Column, label: str, id_column: str, code: str) -> DataFrame:
    return rows.where(holds).select(F.lit(label).alias("label"), F.col(id_column).alias("id"), F.lit(code).alias("code"))


def safe_path(p: Column) -> Column:
    """Relative, and no .. among its parts."""
    return ~(p.rlike(r"^([A-Za-z]:)?[\\/]") | p.rlike(r"(^|[\\/])\.\.([\\/]|$)"))


def validate(papers, evidence, claims, queries, answers, document_qrels, evidence_qrels, pools) -> DataFrame:
    """(label, id, code): every broken rule of benchmark ledgers, as one table.

    papers (paper_id, file_id, artifact_path), evidence (evidence_id, paper_id, file_id, quote, quote_hash, char_start, char_end, group_id),
    claims (claim_id, paper_ids, group_ids), queries (query_id, claim_ids, group_ids), answers (query_id, claim_ids), qrels (query_id, target_id), pools (query_id, kind, target_id).
    """
    first = lambda rows, key: rows.dropDuplicates([key])
    doubled = lambda rows, key, label: rows.groupBy(key).count().where("count > 1").select(F.lit(label).alias("label"), F.col(key).alias("id"), F.lit("duplicate id").alias("code"))
    owners = papers.groupBy("file_id").agg(F.min("paper_id").alias("owner"), F.count_distinct("paper_id").alias("n"))
    owned = evidence.join(owners, "file_id", "left")
    sets = queries.select("query_id", F.array_sort(F.array_distinct("claim_ids")).alias("wanted")).join(answers.select("query_id", F.array_sort(F.array_distinct("claim_ids")).alias("given")), "query_id", "left")
    out = [
        doubled(papers.select("paper_id").distinct() if "line" not in papers.columns else papers.select("paper_id", "line").distinct(), "paper_id", "manifest"), doubled(queries, "query_id", "queries"), doubled(claims, "claim_id", "claims"), doubled(evidence, "evidence_id", "evidence"),
        _wrong(owners, F.col("n") > 1, "manifest", "file_id", "file of several papers"), _wrong(papers, ~safe_path(F.col("artifact_path")), "manifest", "paper_id", "unsafe path"),
        _lacks(evidence, "paper_id", papers, "paper_id", "evidence", "evidence_id", "unknown paper"),
        _wrong(owned, F.col("owner").isNull() | (F.col("owner") != F.col("paper_id")), "evidence", "evidence_id", "file of another paper"),
        _wrong(evidence, F.sha2("quote", 256) != F.col("quote_hash"), "evidence", "evidence_id", "quote hash"), _wrong(evidence, F.col("char_end") <= F.col("char_start"), "evidence", "evidence_id", "empty span"),
        _lacks(claims.select("claim_id", F.explode("paper_ids").alias("x")), "x", papers, "paper_id", "claims", "claim_id", "unknown paper"), _lacks(claims.select("claim_id", F.explode("group_ids").alias("x")), "x", evidence, "group_id", "claims", "claim_id", "unknown group"),
        _lacks(queries.select("query_id", F.explode("claim_ids").alias("x")), "x", claims, "claim_id", "queries", "query_id", "unknown claim"), _lacks(queries.select("query_id", F.explode("group_ids").alias("x")), "x", evidence, "group_id", "queries", "query_id", "unknown group"),
        _wrong(sets, F.col("given").isNull(), "queries", "query_id", "no answer"), _wrong(sets, F.col("given") != F.col("wanted"), "queries", "query_id", "claims differ"),
        _lacks(answers, "query_id", queries, "query_id", "answers", "query_id", "unknown query"),
    ]
    for label, rows, there, key in (("document_qrels", document_qrels, papers, "paper_id"), ("evidence_qrels", evidence_qrels, evidence, "evidence_id")):
        out += [_lacks(rows, "query_id", queries, "query_id", label, "query_id", "unknown query"), _lacks(rows, "target_id", there, key, label, "target_id", "unknown target")]
        out.append(rows.groupBy("query_id", "target_id").count().where("count > 1").select(F.lit(label).alias("label"), F.concat_ws(" ", "query_id", "target_id").alias("id"), F.lit("duplicate judgment").alias("code")))
    out.append(_lacks(pools, "query_id", queries, "query_id", "judgment_pools", "query_id", "unknown query"))
    for kind, there, key in (("document", papers, "paper_id"), ("evidence", evidence, "evidence_id")):
        out.append(_lacks(pools.where(F.col("kind") == kind), "target_id", first(there, key), key, "judgment_pools", "target_id", f"unknown {kind}"))
    return union(out)


def suite_errors(members: DataFrame) -> DataFrame:
    """(rule, n) of suite members (suite, kind, id): s5 within d20, the partitions apart, s100 their union. n: ids that break the rule."""
    by = members.groupBy("kind", "id").agg(F.collect_set("suite").alias("s"))
    has = lambda x: F.array_contains("s", x)
    parted = reduce(Column.__or__, [has(x) for x in PARTITIONS])
    rules = {"s5 within d20": has("s5") & ~has("d20"), "s100 is the union": has("s100") != parted} | {f"{a} and {b} apart": has(a) & has(b) for i, a in enumerate(PARTITIONS) for b in PARTITIONS[i + 1 :]}
    counted = by.groupBy("kind").agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    return counted.unpivot("kind", list(rules), "rule", "n").where("n > 0").select(F.concat_ws(": ", "kind", "rule").alias("rule"), "n")


def release_errors(members: DataFrame, papers: DataFrame, domains: list[str]) -> DataFrame:
    """(suite, rule, wanted, found) where a suite's numbers of papers, queries or papers of a domain are not those of a release."""
    spark = members.sparkSession
    wanted = spark.createDataFrame([(s, "papers", p, False) for s, (p, _, _) in SUITES.items()] + [(s, "queries", q, True) for s, (_, q, _) in SUITES.items()] + [(s, f"domain {d}", n, False) for s, (_, _, n) in SUITES.items() for d in domains], "suite string, rule string, wanted long, least boolean")
    kinds = members.groupBy("suite", F.concat("kind", F.lit("s")).alias("rule")).agg(F.count_distinct("id").alias("found"))
    by_domain = members.where("kind = 'paper'").join(papers, F.col("id") == F.col("paper_id")).groupBy("suite", F.concat(F.lit("domain "), "domain").alias("rule")).agg(F.count_distinct("id").alias("found"))
    told = wanted.join(kinds.unionByName(by_domain), ["suite", "rule"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return told.where(F.when(F.col("least"), F.col("found") < F.col("wanted")).otherwise(F.col("found") != F.col("wanted"))).select("suite", "rule", "wanted", "found")
