"""Session records and plans against plain renderers."""

import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from folioforge.functions import records
from folioforge.jobs import records_catalogue
from folioforge.operators import plans
from folioforge.sources import tables


def plain_session(s):
    fact = lambda label, v: [f"- {label}: {v}"]
    some = lambda label, v: fact(label, v) if v not in (None, "") else []
    lacks = "not recorded"

    def part(title, lines, none):
        return [f"## {title}", "", "\n".join(lines).rstrip() if lines else none, ""]

    runs, notes, papers = [], [], []
    for k, r in enumerate(s.search_runs or [], 1):
        runs += [f"### Run {k}", *some("Role", r.role), *fact("Purpose", r.purpose or lacks), f"- Endpoint: `{r.endpoint or lacks}`", *fact("Query", lacks if r.query is None else r.query), *fact("Filters", r.filters or "none"), *fact("Hits", lacks if r.hits is None else r.hits), ""]
    for k, n in enumerate(s.notes or [], 1):
        notes += [f"### N{k}", *fact("Source", n.source_file or "unknown"), *some("Rank", n.note_rank), *some("Score", n.score), *some("Year", n.year), *some("Journal", n.journal), *some("Zotero key", n.zotero_parent_key), "", "摘录：", "> " + (n.content or "").strip()[:800], ""]
    for k, p in enumerate(s.papers or [], 1):
        papers += [f"### P{k}", *fact("Source", p.pdf_filename or "unknown"), *some("Type", {True: "主文", False: "SI"}.get(p.is_main)), *some("Distance", p.distance), *some("Chunk index", p.chunk_index), *some("Zotero key", p.zotero_parent_key), "", "原文：", "> " + (p.content or "").strip()[:1200]]
        papers += (["", "译：", "> " + p.translation.strip()] if p.translation else []) + [""]
    angle = next((a for a in s.planned_angles or [] if a.strip() != "anchor"), lacks)
    plan = [*fact("Anchor angle", s.anchor_query or s.query or "Not recorded"), *fact("Initial exploratory angle", angle), *fact("Expansion triggered", "yes" if s.expansion_reason else "no"), *some("Expansion reason", s.expansion_reason), *fact("Executed angles", ", ".join(s.executed_angles or []) or lacks), *fact("Stop reason", s.stop_reason or lacks)]
    out = ["# Query Record", "", "## User Query", "", s.query or "", "", "## Workflow Decision", "", f"- Workflow: {s.workflow_id or 'unknown'} · {s.workflow_name or 'unknown'}", f"- Reason: {s.workflow_reason or lacks}", ""]
    out += part("Search Plan", plan, "") + part("Search Runs", runs, "No search runs recorded.") + ["## Result Summary", "", s.result_summary or "No result summary recorded.", ""]
    out += part("Notes Hits", notes, "No note hits recorded.") + part("Paper Hits", papers, "No paper hits recorded.") + ["## Final Response Snapshot", "", s.final_response_snapshot or "", "", "## Follow-up Actions"]
    text = "\n".join(out) + "\n"
    for a in s.actions or []:
        block = [f"### {a.timestamp}", *fact("Action", a.action or "unknown"), *fact("Result", a.result or lacks)]
        text = text.rstrip() + "\n\n" + "\n".join(block + [f"- {d.key.replace('_', ' ').title()}: {d.value}" for d in a.details or [] if d.value]) + "\n"
    return text


def test_sessions(spark, sf):
    rows = records_catalogue.sessions_of(spark, sf)
    got = {r.conv_id: r.m for r in rows.select("conv_id", records.session_markdown().alias("m")).collect()}
    for s in rows.collect():
        assert got[s.conv_id] == plain_session(s), s.conv_id
    want = {k: hashlib.md5(v.encode()).hexdigest() for k, v in got.items()}
    assert dict(map(tuple, records_catalogue.session_markdown(spark, sf).collect())) == want


def test_a_session_without_anything(spark):
    row = spark.createDataFrame([(None,) * 15], records.SESSION)
    assert row.select(records.session_markdown().alias("m")).first().m == plain_session(row.first())
    text = lambda c, a: spark.createDataFrame([(c, a)], "c string, a array<struct<timestamp:string,action:string,result:string,details:array<struct<key:string,value:string>>>>").select(records.with_follow_ups(F.col("c"), F.col("a")).alias("x")).first().x
    block = ("t1", "save", None, [("by_whom", "me"), ("why", None)])
    once = text("body\n\n", [block])
    assert once == "body\n\n## Follow-up Actions\n\n### t1\n- Action: save\n- Result: not recorded\n- By Whom: me\n"
    assert text(once, [("t2", "x", "y", None)]) == once + "\n### t2\n- Action: x\n- Result: y\n" and text("body", []) == "body"


def test_plans(spark, sf):
    files, parts, profiles = records_catalogue.plan_inputs(spark, sf)
    made = {r.grp: r for r in plans.model_plans(files, parts, profiles, F.lit("now"), "v3", "note").collect()}
    assert list(plans.FIELDS) == [c for c in next(iter(made.values())).asDict() if c != "grp"] and len(plans.FIELDS) == 20
    by, cut, kinds = defaultdict(list), defaultdict(list), {r.grp: r.document_type for r in profiles.collect()}
    for f in files.collect():
        by[f.grp].append(f)
    for p in parts.collect():
        cut[p.path].append(p)
    for grp, own in by.items():
        own.sort(key=lambda f: f.place)
        r, first, pages = made[grp], own[0], sum(f.pages for f in own)
        assert r.pdf_paths == [f.path for f in own] and r.pdf_page_counts == [f.pages for f in own] and r.pdf_file_sizes_bytes == [f.size for f in own]
        assert (r.primary_pdf_pages, r.total_pdf_pages, r.primary_pdf_size_bytes, r.total_pdf_size_bytes) == (first.pages, pages, first.size, sum(f.size for f in own))
        want = [(f.path, p.part_index, p.page_start, p.page_end) for f in own for p in sorted(cut[f.path], key=lambda p: p.part_index)]
        assert [(m.source_pdf_path, m.part_index, m.page_start, m.page_end) for m in r.prepared_pdf_manifest] == want and r.chunking_enabled == bool(want)
        assert r.prepared_pdf_paths == [x for f in own for x in ([f"{f.path}#{p.page_start}-{p.page_end}" for p in sorted(cut[f.path], key=lambda p: p.part_index)] or [f.path])]
        large = first.pages >= 30 or pages >= 60 or kinds[grp] == "review"
        assert r.note_generator_model == ("pro" if large else "flash") and r.policy_version == "v3" and r.manual_model_override is None
    small = plans.model_plans(files.limit(1), parts.limit(0), profiles.limit(0), F.lit("now"), override="mine", flash_override="f2").first()
    assert (small.note_generator_model, small.note_generator_reason, small.profiler_model, small.chunking_enabled) == ("mine", "manual override (--model)", "f2", False)
    assert json.dumps(small.prepared_pdf_paths) == json.dumps(small.pdf_paths) and records_catalogue.model_plan_record(spark, sf).count() == len(by)


def test_seed_terms(spark):
    rows = [(["Graphene oxide", "copper", "copper", " "], ["Reduced graphene oxide films"], ["copper"], ["energy"]), (["unrelated"], ["t"], ["a", "b", "a"], [f"t{i}" for i in range(12)]), ([], ["t"], ["k"], ["x"]), (None, None, None, None), (["zzz"], None, None, None)]
    df = spark.createDataFrame(rows, "s array<string>, t array<string>, k array<string>, o array<string>")
    got = [r.x for r in df.select(records.seed_terms(F.col("s"), F.col("t"), F.col("k"), F.col("o")).alias("x")).collect()]
    assert got == [["Graphene oxide", "copper"], ["a", "b", *[f"t{i}" for i in range(8)]], [], [], []]


def test_notes_are_files_of_few_tasks(spark, tmp_path):
    """One file a note, whatever it holds; a task reads thousands of them."""
    texts = [None if i == 3 else "" if i == 4 else f"näme {i}\n\nline\r\n" for i in range(1500)]
    rows = [("domain/notes" if i % 3 else ".tmp-drafts" if i % 2 else "progress/gate_reports", t or "") for i, t in enumerate(texts)]
    for root in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        tables.write_notes(spark.createDataFrame(rows, "folder string, text string"), root)
        assert len(list((tmp_path / root[-1]).rglob("*.txt"))) == 1500
        found = tables.notes(spark, root, suffix=".txt")
        assert sorted(r.content for r in found.collect()) == sorted(t + "\n" for f, t in rows if f == "domain/notes")
        assert found.rdd.getNumPartitions() <= 8
