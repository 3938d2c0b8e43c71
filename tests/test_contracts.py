"""Chunkers, planners, schema checks, agreement, gates and the context cache against plain versions and known answers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import schema
from folioforge.jobs import contract_catalogue
from folioforge.operators import chunking, context, evaluation, routing


def plain_chunks(text, target, most, bind=False):
    """(index, path, start, stop, captions) by a loop over lines."""
    chunks, notes, path, open_, at = [], [], {}, [], 0
    for line in (text or "").split("\n"):
        start, at = at, at + len(line) + 1
        if not line.strip():
            continue
        head = re.fullmatch(r"(#{1,6})\s+(.*\S)\s*", line)
        if bind and not head and re.match(chunking.CAPTION, line):
            notes.append((start, start + len(line), line))
            continue
        if head:
            if open_:
                chunks.append((shown, open_))
            open_, path = [], {k: v for k, v in path.items() if k < len(head[1])} | {len(head[1]): head[2]}
        shown = " > ".join(path[k] for k in sorted(path))
        if open_ and (open_[-1][1] - open_[0][0] >= target or start + len(line) - open_[0][0] > most):
            chunks.append((shown, open_))
            open_ = []
        for a in range(start, start + len(line), most):
            if a > start:
                chunks.append((shown, open_))
                open_ = []
            open_ = [*open_, (a, min(start + len(line), a + most))]
    if open_:
        chunks.append((shown, open_))
    held = {k: [] for k in range(len(chunks))}
    for start, stop, line in notes:
        near = [(start - b if b <= start else a - stop, a > start, k) for k, (_, ps) in enumerate(chunks) for a, b in ps]
        if near:
            held[min(near)[2]].append((start, line))
    return [(k, p, ps[0][0], ps[-1][1], held[k]) for k, (p, ps) in enumerate(chunks)]


TEXT = "intro line\n\n# One\nbody of one that is long enough\nFigure 1: near one\n## Deep 𝒳\nTable 2. first\nmore body\n" + "w" * 95 + "\n# Two\n### Skipped\nx\n\n图 3 last\n" + "y z " * 9


@pytest.mark.parametrize("bind", [False, True])
def test_sections_and_captions(spark, sf, bind):
    own = [(1, TEXT), (2, None), (3, ""), (4, "# only"), (5, "Figure 1 alone"), (6, "\n \n"), (7, "q" * 130), (8, "a\nTable 1\nb"), (9, "#no\n####### no\n# \nTable 3\n")]
    rows = own + [(100 + r.doc_id, r.text) for r in contract_catalogue.sectioned(spark, sf).limit(40).collect()]
    cut = chunking.bound_chunks if bind else chunking.section_chunks
    got = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), target=40, most=60).collect()
    texts = dict(rows)
    assert all(r.chunk == texts[r.doc_id][r.start : r.stop] and 0 < len(r.chunk) <= 60 for r in got)
    told = sorted((r.doc_id, r.chunk_index, r.section_path, r.start, r.stop, [tuple(c) for c in r.captions] if bind else []) for r in got)
    assert told == sorted((i, *c) for i, t in rows for c in plain_chunks(t, 40, 60, bind))
    assert not bind or any(c[5] for c in told)


def test_section_queries(spark, sf):
    docs = {r.doc_id: r.text for r in contract_catalogue.sectioned(spark, sf).collect()}
    for query, bind in ((contract_catalogue.chunk_sections, False), (contract_catalogue.chunk_captions, True)):
        got = sorted((r.doc_id, r.chunk_index, r.section_path, r.start, r.stop) for r in query(spark, sf).collect())
        assert got == sorted((i, *c[:4]) for i, t in docs.items() for c in plain_chunks(t, 800, 1200, bind))


@pytest.mark.parametrize("pages, want", [([10] * 4, [(1, 4, 40)]), ([10] * 7, [(1, 4, 40), (5, 7, 30)]), ([60, 60, 60, 1, 1, 1, 1, 1], [(1, 1, 60), (2, 2, 60), (3, 6, 63), (7, 8, 2)]), ([60, 60, 1], [(1, 1, 60), (2, 3, 61)]), ([1, 70, 101, 1], None), ([], None), (None, None)])
def test_halving(spark, pages, want):
    rows = routing.planned_parts(spark.createDataFrame([("f", pages)], "file string, pages array<long>"), "file", 100, 4).collect()
    if want is None:
        assert [(r.reason, r.page_start) for r in rows] == [("oversize_pdf", 3) if pages else ("corrupt_pdf", None)]
    else:
        assert [(r.page_start, r.page_end, r.bytes) for r in rows] == want and [r.part_index for r in rows] == list(range(len(want)))


def plain_fault(value, rule, path="root"):
    kind = rule.get("type")
    if value is None and rule.get("nullable"):
        return None
    checks = {"OBJECT": (dict, "a JSON object"), "ARRAY": (list, "a list"), "BOOLEAN": (bool, "a boolean"), "INTEGER": (int, "an integer"), "STRING": (str, "a string")}
    if kind in checks and not isinstance(value, checks[kind][0]):
        return f"Field {path} must be {checks[kind][1]}."
    if kind == "OBJECT":
        found = [f"Missing required field: {x}" for x in rule.get("required", []) if x not in value]
        found += [plain_fault(value[k], child, f"{path}.{k}") for k, child in rule.get("properties", {}).items() if k in value]
        return next((x for x in found if x), None)
    if kind == "ARRAY":
        return next((x for i, v in enumerate(value) if (x := rule.get("items") and plain_fault(v, rule["items"], f"{path}[{i}]"))), None)
    if "enum" in rule and kind in ("STRING", None) and value not in rule["enum"]:
        return f"Field {path} must be one of {rule['enum']}."


RULE = {
    "type": "OBJECT", "required": ["a", "b"],
    "properties": {"a": {"type": "ARRAY", "items": {"type": "OBJECT", "required": ["k"], "properties": {"k": {"type": "STRING", "enum": ["x", "y's"]}, "n": {"type": "ARRAY", "nullable": True, "items": {"type": "INTEGER"}}}}},
                   "b": {"type": "BOOLEAN", "nullable": True}, "odd name": {"type": "STRING"}, "e": {"enum": [1, "two", None]}},
}


def test_nested_schema(spark):
    values = [{}, [], None, 3, "s", {"a": []}, {"a": [], "b": None}, {"a": {}, "b": True}, {"a": [{"k": "x"}, {"k": "z"}], "b": 1}, {"a": [{"k": "x", "n": [1, 2, 1.5]}], "b": False}, {"a": [{"k": "x", "n": None}, {"n": []}], "b": False},
              {"a": [{"k": "y's", "n": [True, 10**20, -3]}], "b": False}, {"a": [None], "b": None}, {"a": [{"k": None}], "b": True}, {"a": [], "b": "no"}, {"a": [], "b": True, "odd name": 5}, {"a": [], "b": True, "odd name": "v", "more": [1]},
              {"a": [], "b": True, "e": 1}, {"a": [], "b": True, "e": "two"}, {"a": [], "b": True, "e": None}, {"a": [], "b": True, "e": "1"}, {"a": [{"k": "x", "n": [[1]]}], "b": True}, {"a": [{"k": "x", "n": [1e3]}], "b": True}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(90, "{"), (91, ""), (92, None)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k int, j string").select("k", schema.json_fault(F.col("j"), RULE).alias("f")).collect()))
    assert got == {k: plain_fault(v, RULE) for k, v in enumerate(values)} | {90: "not JSON", 91: "not JSON", 92: "not JSON"}


def test_alpha_of_the_worked_example(spark):
    """Four assessors, twelve units, gaps: 0.815 for ordinal data in Krippendorff's own example."""
    told = ["1 2 3 3 2 1 4 1 2 . . .", "1 2 3 3 2 2 4 1 2 5 . 3", ". 3 3 3 2 3 4 2 2 5 1 .", "1 2 3 3 2 4 4 1 2 5 1 ."]
    rows = [(u, None if v == "." else int(v)) for line in told for u, v in enumerate(line.split())]
    got = evaluation.krippendorff_alpha(spark.createDataFrame(rows, "unit int, grade int"), "unit", "grade").first()
    assert (round(got.alpha, 3), got.n_values, got.n_units) == (0.815, 40, 11)
    alike = evaluation.krippendorff_alpha(spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "unit int, grade int"), "unit", "grade").first()
    assert alike.alpha is None and alike.n_values == 2
    none = evaluation.krippendorff_alpha(spark.createDataFrame([], "unit int, grade int"), "unit", "grade").first()
    assert none.alpha is None and none.n_values == 0


def test_each_gate_fails_for_its_own_reason(spark, sf):
    got = {r.experiment: r for r in contract_catalogue.release_gates(spark, sf).collect()}
    flags = {k: (r.primary_ok, r.guard_ok, r.slices_ok, r.latency_ok) for k, r in got.items()}
    assert got[4].decision == "ship" and got[2].decision == "reject" and not flags[2][0]
    assert flags[5] == (True, False, True, True) and got[5].decision == "reject"
    assert flags[6][2] is False and flags[7] == (True, True, True, False) and got[7].decision == "owner"


def test_draws_of_many_clusters_are_not_sent_whole(spark):
    """The weights of all clusters, a thousand each, stay in their tasks; the means are those of plain sums, with nulls left out."""
    import hashlib

    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(e), f"d{c % 2}", int(c), float(x), None if c == 5 else float(x + y)) for e, c, x, y in zip(rng.integers(0, 3, 3000), rng.integers(0, 1500, 3000), rng.random(3000), rng.random(3000), strict=True)]
    rows += [(1, "d2", 7, 0.5, None), (1, "d0", None, 9.0, 9.0), (None, None, 8, 1.0, 2.0)]
    df = evaluation.drawn_means(spark.createDataFrame(rows, "experiment int, domain string, cluster long, a double, b double"), "experiment", "domain", "cluster", "a", "b", samples=50)
    got = {(r.experiment, r.sample): (r.delta, r.base) for r in df.collect()}
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    u = lambda c, k: int(hashlib.md5(f"{c}|{k}|7".encode()).hexdigest()[:8], 16) / (1 << 32)
    edges = evaluation.poisson_edges()
    weight = {(c, k): sum(u(c, k) >= x for x in edges) for c in {r[2] for r in rows if r[2] is not None} for k in range(50)}
    for (e, k), told in got.items():
        of = {}
        for x, m, c, a, b in rows:
            if x == e and c is not None:
                s = of.setdefault(m, [0, 0, 0, 0])
                s[0] += weight[c, k] * (b - a if b is not None else 0)
                s[1] += weight[c, k] * a
                s[2] += weight[c, k]
                s[3] += b is not None
        d, base = ([s[i] / s[2] for s in of.values() if s[2] and (i or s[3])] for i in (0, 1))
        assert np.allclose([np.mean(d) if d else np.nan, np.mean(base) if base else np.nan], [np.nan if v is None else v for v in told], equal_nan=True)
    assert len(got) == 200


def test_contexts_are_made_once(spark, tmp_path):
    chunks = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", None)], "document_hash string, chunk string")
    made = []

    def make(misses):
        made.append(misses.count())
        return misses.withColumn("context", F.concat("document_hash", F.lit("/"), F.coalesce("chunk", F.lit("?"))))

    cache = context.store(spark, str(tmp_path), 8)
    run = lambda prompt, version: sorted(map(tuple, context.with_context(chunks, cache, prompt, "m", make, version).select("document_hash", "chunk", "context", "hit").collect()), key=repr)
    first = run("p", "v1")
    assert made == [4] and not any(r[3] for r in first) and ("d2", "a", "d2/a", False) in first and len(first) == 5
    again = run("p", "v2")
    assert made == [4, 0] and all(r[3] for r in again) and [r[:3] for r in again] == [r[:3] for r in first]
    run("another prompt", "v3")
    assert made == [4, 0, 4] and cache.rows().count() == 8
    # what is null is not kept
    context.with_context(chunks, cache, "third", "m", lambda x: x.withColumn("context", F.when(F.col("chunk") == "b", "B")), "v4")
    assert cache.rows().count() == 9
