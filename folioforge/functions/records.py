"""Records of a session, as Markdown, and of an analysis, as a struct; seed terms kept to what a note is about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import grounded

#: Labels of a session's Markdown, and what stands where something lacks.
LACKS = "not recorded"
FOLLOW_UP = "## Follow-up Actions"
EXCERPT, ORIGINAL, TRANSLATION, MAIN, SUPPLEMENT = "摘录：", "原文：", "译：", "主文", "SI"

#: Schema of what session_markdown() reads. Arrays may be null, which is empty.
SESSION = """query string, workflow_id string, workflow_name string, workflow_reason string, anchor_query string, planned_angles array<string>, executed_angles array<string>, expansion_reason string, stop_reason string,
search_runs array<struct<role:string,purpose:string,endpoint:string,query:string,filters:string,hits:int>>, result_summary string,
notes array<struct<source_file:string,note_rank:int,score:double,year:string,journal:string,zotero_parent_key:string,content:string>>,
papers array<struct<pdf_filename:string,is_main:boolean,distance:double,chunk_index:int,zotero_parent_key:string,content:string,translation:string>>,
final_response_snapshot string, actions array<struct<timestamp:string,action:string,result:string,details:array<struct<key:string,value:string>>>>"""


def _filled(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value.cast("string"), F.lit(""))


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")


def _fact(label: str, value: Column) -> Column:
    """A line of a list; null without a value, and joins leave nulls out."""
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def _quoted(label: str, value: Column, most: int) -> Column:
    return F.concat(F.lit(f"\n{label}\n> "), F.substring(_bare(value), 1, most))


def _items(items: Column, mark: str, shown: Callable[[Column], list[Column]], none: str) -> Column:
    """Each item under a numbered heading, blank lines between them; none if there is no item."""
    each = F.transform(items, lambda x, i: F.concat_ws("\n", F.concat(F.lit(f"### {mark}"), (i + 1).cast("string")), *shown(x)))
    return F.when(F.coalesce(F.size(items), F.lit(0)) < 1, none).otherwise(F.regexp_replace(F.array_join(each, "\n\n"), r"\s+$", ""))


def _section(title: str, body: Column, level: int = 2) -> Column:
    return F.concat(F.lit(f"{'#' * level} {title}\n\n"), body)


def _run(x: Column) -> list[Column]:
    said = lambda f: F.coalesce(x[f].cast("string"), F.lit(LACKS))
    code = lambda f: F.concat(F.lit("`"), said(f), F.lit("`"))
    return [_fact("Role", _filled(x["role"])), _fact("Purpose", said("purpose")), _fact("Endpoint", code("endpoint")), _fact("Query", said("query")), _fact("Filters", F.coalesce(_filled(x["filters"]), F.lit("none"))), _fact("Hits", said("hits"))]


def _note(x: Column) -> list[Column]:
    facts = [_fact("Source", F.coalesce(x["source_file"], F.lit("unknown"))), _fact("Rank", x["note_rank"]), _fact("Score", x["score"]), _fact("Year", _filled(x["year"])), _fact("Journal", _filled(x["journal"])), _fact("Zotero key", _filled(x["zotero_parent_key"]))]
    return [*facts, _quoted(EXCERPT, x["content"], 800)]


def _paper(x: Column) -> list[Column]:
    facts = [_fact("Source", F.coalesce(x["pdf_filename"], F.lit("unknown"))), _fact("Type", F.when(x["is_main"], MAIN).when(~x["is_main"], SUPPLEMENT)), _fact("Distance", x["distance"]), _fact("Chunk index", x["chunk_index"]), _fact("Zotero key", _filled(x["zotero_parent_key"]))]
    return [*facts, _quoted(ORIGINAL, x["content"], 1200), F.when(_filled(x["translation"]).isNotNull(), _quoted(TRANSLATION, x["translation"], 1 << 30))]


def follow_up(action: Column) -> Column:
    """A block (timestamp, action, result, details) of a session's follow-up; details without a value are left out, and their keys read as titles."""
    title = lambda key: F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
    details = F.transform(F.filter(F.coalesce(action["details"], F.array().cast("array<struct<key:string,value:string>>")), lambda d: _filled(d["value"]).isNotNull()), lambda d: F.concat(F.lit("- "), title(d["key"]), F.lit(": "), d["value"]))
    lines = F.concat_ws("\n", _fact("Action", F.coalesce(action["action"], F.lit("unknown"))), _fact("Result", F.coalesce(action["result"], F.lit(LACKS))), F.nullif(F.array_join(details, "\n"), F.lit("")))
    return F.concat(F.lit("### "), action["timestamp"], F.lit("\n"), lines)


def with_follow_ups(content: Column, actions: Column) -> Column:
    """A session's Markdown with blocks appended: the heading is put before the first if it is not there yet, and never twice."""
    end = F.regexp_replace(content, r"\s+$", "")
    headed = F.when(content.contains(FOLLOW_UP), end).otherwise(F.concat(end, F.lit(f"\n\n{FOLLOW_UP}")))
    blocks = F.array_join(F.transform(actions, follow_up), "\n\n")
    return F.when(F.coalesce(F.size(actions), F.lit(0)) < 1, content).otherwise(F.concat(headed, F.lit("\n\n"), blocks, F.lit("\n")))


def search_plan() -> Column:
    angles, reason = F.coalesce("planned_angles", F.array().cast("array<string>")), _filled(F.col("expansion_reason"))
    executed = F.nullif(F.array_join(F.coalesce("executed_angles", F.array().cast("array<string>")), ", "), F.lit(""))
    first = F.try_element_at(F.filter(angles, lambda a: F.trim(a) != "anchor"), F.lit(1))
    said = lambda c: F.coalesce(c, F.lit(LACKS))
    return F.concat_ws("\n",
        _fact("Anchor angle", F.coalesce(_filled(F.col("anchor_query")), _filled(F.col("query")), F.lit("Not recorded"))), _fact("Initial exploratory angle", said(first)), _fact("Expansion triggered", F.when(reason.isNull(), "no").otherwise("yes")),
        _fact("Expansion reason", reason), _fact("Executed angles", said(executed)), _fact("Stop reason", said(_filled(F.col("stop_reason")))))


def session_markdown() -> Column:
    """The whole record of a session (columns of SESSION) below its frontmatter: query, decision, plan, runs, summary, note and paper hits with excerpts, the answer, and what followed.

    Sections stand in a fixed order, and one without anything says so; the last heading is there even if nothing followed.
    """
    col = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    decision = F.concat_ws("\n", _fact("Workflow", F.concat(col("workflow_id", "unknown"), F.lit(" · "), col("workflow_name", "unknown"))), _fact("Reason", col("workflow_reason", LACKS)))
    sections = [
        F.lit("# Query Record"), _section("User Query", col("query")), _section("Workflow Decision", decision), _section("Search Plan", search_plan()), _section("Search Runs", _items(F.col("search_runs"), "Run ", _run, "No search runs recorded.")),
        _section("Result Summary", col("result_summary", "No result summary recorded.")), _section("Notes Hits", _items(F.col("notes"), "N", _note, "No note hits recorded.")), _section("Paper Hits", _items(F.col("papers"), "P", _paper, "No paper hits recorded.")),
        _section("Final Response Snapshot", col("final_response_snapshot")), F.lit(FOLLOW_UP),
    ]
    return with_follow_ups(F.concat(F.concat_ws("\n\n", *sections), F.lit("\n")), F.col("actions"))


def seed_terms(terms: Column, titles: Column, keywords: Column, topics: Column, most: int = 10) -> Column:
    """The terms that a title, keyword or topic bears out, each once; if it is none of them, the first `most` keywords and topics. No terms stay none. Arrays may be null; blank entries don't count."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    own, anchors = clean(terms), F.concat(clean(titles), clean(keywords), clean(topics))
    kept = F.array_distinct(F.filter(own, lambda t: F.exists(anchors, lambda a: grounded(t, a))))
    other = F.slice(F.array_distinct(F.concat(clean(keywords), clean(topics))), 1, most)
    return F.when(F.size(own) == 0, own).when(F.size(kept) > 0, kept).otherwise(other)
