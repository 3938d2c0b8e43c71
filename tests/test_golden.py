"""Golden cases of single expressions and operators."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import identity, notes, text
from folioforge.operators import dedup, evaluation, index, routing, search
from folioforge.sources.tables import json_lines, ledger_last_wins, ledger_set
from folioforge.streaming.incremental import incremental_chunks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("n, want", [(0, []), (100, []), (101, [(0, 101)]), (800, [(0, 800), (700, 100)][:1]), (801, [(0, 800), (700, 101)]), (1700, [(0, 800), (700, 800), (1400, 300)])])
def test_chunks(spark, n, want):
    rows = text.chunk_rows(spark.createDataFrame([("x" * n,)], "text string")).orderBy("chunk_index").collect()
    assert [(r.chunk_start, len(r.chunk)) for r in rows] == want and [r.chunk_index for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("bad", [{"size": 0}, {"step": 0}, {"least": -1}])
def test_chunk_arguments(spark, bad):
    with pytest.raises(ValueError):
        text.chunk_rows(spark.createDataFrame([("x",)], "text string"), **bad)


@pytest.mark.parametrize("given, want", [("a\nReferences\nb\nBIBLIOGRAPHY \nc", "a\nReferences\nb"), ("a\nReferences\nReferences\nx", "a"), ("a\nReferences　\nx", "a"), ("a\nReferences \nx", "a"), ("a References\nx", "a References\nx"), ("a\n参考文献\n", "a"), ("", "")])
def test_references(spark, given, want):
    assert one(spark, text.without_references(F.col("t")), t=given) == want


def test_text(spark):
    assert one(spark, text.joined_pages(F.array(F.col("a"), F.lit(None), F.col("a"))), a="p") == "p\n\np"
    assert [one(spark, text.language_hint(F.col("a")), a=x) for x in ("", "中a", "a")] == ["unknown", "zh", "en"]
    assert [one(spark, text.slug(F.col("a")), a=x) for x in ('  a/b: c  "d" ', "???", "x" * 31 + " - y")] == ["ab-c-d", "query", "x" * 31]
    assert one(spark, text.session_title(F.col("a"), F.lit("q")), a="\n  Two  words.; \nmore") == "Two words"
    assert [one(spark, text.yaml_scalar(F.col("a")), a=x) for x in ("", "2024", "it's: x", "plain")] == ["''", "2024", "'it''s: x'", "plain"]
    block, body = text.frontmatter_parts(F.col("a"))
    assert (one(spark, block, a="---\nk: v\n---\nbody"), one(spark, body, a="---\nk: v\n---\nbody"), one(spark, body, a="no block")) == ("k: v", "body", "no block")
    assert [one(spark, text.grounded(F.col("a"), F.lit("Oxygen evolution")), a=x) for x in ("oxygen", "oxy", "OXYGEN-EVOLUTION", "")] == [True, False, True, False]


def test_identity(spark):
    rows = [("g", "/a/Main.pdf", "h2"), ("g", "/a/main.PDF", "h2"), ("g", "/a/si.pdf", "h1"), ("r", "/z", "h1"), ("r", "/y", "h2")]
    got = {r.g: r for r in identity.combined_hashes(spark.createDataFrame(rows, "g string, path string, digest string"), "g").collect()}
    assert got["g"].stable == got["r"].stable and got["g"].variants == 2 and got["r"].legacy != got["r"].stable or got["r"].variants == 2
    before, after = identity.neighbour_ids(F.col("a"))
    assert [(one(spark, before, a=x), one(spark, after, a=x)) for x in ("g_chunk_7", "g_chunk_0", "a_chunk_b_chunk_2", "none")] == [("g_chunk_6", "g_chunk_8"), (None, "g_chunk_1"), ("a_chunk_b_chunk_1", "a_chunk_b_chunk_3"), (None, None)]


def test_notes(spark):
    names = ["A — b.pdf", "x-review_note.md", "", "a/b?c*", "y_review_note"]
    assert [one(spark, notes.note_file_name(F.col("a"), "f"), a=x) for x in names] == ["A-b_review_note.md", "x_review_note.md", "f_review_note.md", "bc_review_note.md", "y_review_note.md"]
    body = f"# {notes.BIBLIOGRAPHY}\nx\n\n# Next\ny"
    section = f"{notes.ABSTRACT}\nabs"
    placed = one(spark, notes.with_section(F.col("a"), F.lit(section)), a=body)
    assert placed == f"# {notes.BIBLIOGRAPHY}\nx\n\n{section}\n\n# Next\ny" and one(spark, notes.with_section(F.col("a"), F.lit(section)), a=placed) == placed
    assert one(spark, notes.with_section(F.col("a"), F.lit(section)), a="z") == f"{section}\n\nz"
    assert one(spark, notes.storage_key(F.col("a")), a="/x/storage/AB12cd34/f.pdf") == "AB12cd34" and one(spark, notes.storage_key(F.col("a")), a="/x/f.pdf") is None
    allowed = {"tag": "tag", "index": "index_note"}
    assert [one(spark, F.array_join(notes.actions(F.col("a"), allowed, ["tag"]), ","), a=x) for x in ("auto", "index, TAG index", "tag none")] == ["tag", "index_note,tag", ""]
    with pytest.raises(Exception, match="unknown action"):
        one(spark, F.array_join(notes.actions(F.col("a"), allowed, ["tag"]), ","), a="other")


def test_ledgers(spark):
    lines = spark.createDataFrame([(1, "a\t1"), (2, "b"), (3, "a\t2"), (4, " ")], "seq long, line string")
    assert {r.name: r.digest for r in ledger_last_wins(lines).collect()} == {"a": "2", "b": ""}
    assert ledger_set(lines.withColumnRenamed("line", "value")).count() == 3
    rows = json_lines(spark.createDataFrame([(1, '﻿{"k": 1}'), (2, ""), (3, "[1]"), (4, "{")], "line_no long, value string"), "k long").collect()
    assert {r.line_no: r.error is None for r in rows} == {1: True, 3: False, 4: False}
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "1")], "name string, digest string")
    ledger = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "1"), ("d", "1")], "name string, digest string")
    there = spark.createDataFrame([(x,) for x in "abde"], "name string")
    assert {r.name: r.action for r in dedup.ingest_plan(files, ledger, there).collect()} == {"a": "skip", "b": "upgrade", "c": "process", "d": "process", "e": "process"}
    audit = {r.value: r.state for r in dedup.ledger_audit(spark.createDataFrame([("v",), ("o",)], "value string"), spark.createDataFrame([("v",), ("g",)], "value string")).collect()}
    assert audit == {"v": "valid", "o": "orphan", "g": "ghost"}


def test_priority(spark):
    groups = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "h string")
    vault, ledger = spark.createDataFrame([("h1", "n2"), ("h1", "n1")], "h string, path string"), spark.createDataFrame([("h1", None), ("h2", None)], "h string, path string")
    got = {r.h: (r.source_kind, r.path) for r in dedup.priority_lookup(groups, "h", [("vault", vault, "path"), ("ledger", ledger, "path")]).collect()}
    assert got == {"h1": ("vault", "n1"), "h2": ("ledger", None), "h3": (None, None)}


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = index.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, index.upsert(once, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_versions(spark, tmp_path):
    df = spark.range(3)
    index.publish(df, f"{tmp_path}/i", "v1", "s1")
    index.publish(df.limit(1), f"{tmp_path}/i", "v2", "s1")
    assert index.current(spark, f"{tmp_path}/i", "s1").count() == 1
    with pytest.raises(ValueError):
        index.current(spark, f"{tmp_path}/i", "s2")


def test_routes(spark):
    model, reason = routing.route(F.col("p").cast("int"), F.col("t").cast("int"), F.col("k"), F.lit(False))
    got = [(one(spark, model, p=p, t=t, k=k), one(spark, reason, p=p, t=t, k=k)) for p, t, k in (("30", "30", "x"), ("1", "60", "x"), ("1", "1", "review"), ("1", "1", "x"))]
    assert [g[0] for g in got] == ["pro", "pro", "pro", "flash"] and got[2][1] == "document_type=review"
    assert search.one_predicate(None, 0, "f") is not None and search.one_predicate(None, None, "") is None


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, None), (2, 1, None)], "q long, rank int, relevance int")
    relevant = spark.createDataFrame([(1, 2), (2, 1)], "q long, n_relevant long")
    got = {r.q: r for r in evaluation.retrieval_metrics(hits, relevant, "q").collect()}
    assert (got[1].recall, got[1].mrr, got[1].judged, got[2].mrr) == (0.5, 0.5, 2, 0.0)
    low, mean, high = evaluation.bootstrap_interval(spark.range(50).select(F.col("id").alias("c"), (F.col("id") % 3 + 2.0).alias("a"), F.lit(1.0).alias("b")), "c", "a", "b", samples=300).first()
    assert low < mean < high and abs(mean - 1.98) < 0.1


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 100").write.parquet(f"{tmp_path}/in")
    run = lambda: incremental_chunks(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/ledger")
    first = run().count()
    docs.where("doc_id >= 100").write.mode("append").parquet(f"{tmp_path}/in")
    rows = run()
    assert first < rows.count() == text.chunk_rows(docs.select("doc_id", "text")).count()
    assert run().count() == rows.count()


def test_chunks_put_together_give_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = text.chunk_rows(docs, least=0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("chunk", 1, 700).alias("c")))).alias("c"))
    assert rows.join(docs, "doc_id").where(F.array_join(F.transform("c", lambda x: x["c"]), "") != F.col("text")).count() == 0


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xxone two three\nfour fivexx"), (2, "one two\nthree four"), (3, "two three"), (4, ""), (5, None), (6, "a one two three four b one two three four")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "one two three\nfour"), (2, "one two three four"), (3, "two"), (4, None), (5, "ne two three\nfour fi")], "item_id long, text string")
    got = {tuple(r) for r in search.containing(docs, quotes, "doc_id", "item_id").collect()}
    assert got == {(1, 1), (5, 1), (2, 6), (3, 1), (3, 2), (3, 3), (3, 6)}


def test_a_path_that_comes_again_replaces_its_chunks(spark, tmp_path):
    from folioforge.streaming.incremental import incremental_chunks

    first = spark.createDataFrame([(1, "a" * 900), (2, "b" * 900), (3, "c" * 900)], "doc_id long, text string")
    first.write.parquet(str(tmp_path / "in/one.parquet"))
    run = lambda: {r.doc_id: r.n for r in incremental_chunks(spark, str(tmp_path / "in/*.parquet"), first.schema, str(tmp_path / "out"), str(tmp_path / "ledger")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert run() == {1: 2, 2: 2, 3: 2}
    spark.createDataFrame([(2, "b" * 300), (3, "short"), (4, "d" * 1700)], first.schema).write.parquet(str(tmp_path / "in/two.parquet"))
    assert run() == {1: 2, 2: 1, 4: 3} == run()


def test_live_notes(spark):
    from folioforge.sources.tables import live_note

    paths = ["a_review_note.md", "progress/x.md", "progress/gate_reports/x.md", ".claude/a.md", "b/.tmpfile/c.md", "b/.obsidian/c.md", "b/c.md", "x/progress/gate_reports/y.md"]
    assert [r.live for r in spark.createDataFrame([(p,) for p in paths], "p string").select(live_note(F.col("p")).alias("live")).collect()] == [True, True, False, False, False, False, True, True]


def test_keep_first_with_ties(spark):
    rows = spark.createDataFrame([("s", 1, "b"), ("s", 1, "a"), ("t", 1, "c")], "sig string, at long, x string")
    assert sorted(map(tuple, dedup.keep_first(rows, "sig", "at").collect())) == [(1, "a", 2), (1, "c", 1)]


def test_paragraphs_are_packed_as_by_a_loop(spark):
    from folioforge.functions.text import packed_chunks

    texts = ["a" * 500 + "\n" + "b" * 299 + "\n\n" + "c" * 10 + "\n" + "d" * 900 + "\ne", "", "\n\n", "x\n" * 600, None]
    got = {}
    for r in packed_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    for i, t in enumerate(texts):
        want = []
        for p in (t or "").split("\n"):
            if p and want and len(want[-1]) + 1 + len(p) <= 800:
                want[-1] += "\n" + p
            elif p:
                want.append(p)
        assert [got.get(i, {})[k] for k in range(len(want))] == want and len(got.get(i, {})) == len(want)


def test_one_line_abstracts(spark):
    from folioforge.functions.notes import one_line_abstract

    cases = {
        "Abstract:\n\nThe first line\r\nand the next\n, then more.": "The first line and the next, then more.", "a well-\nknown case": "a well-known case", "Reduction of CO\n2\nto fuel": "Reduction of CO2 to fuel", "CO 2 and Na + ions at 5 cm -2": "CO2 and Na + ions at 5 cm-2",
        "C - C bonds ( as shown ) .": "C-C bonds (as shown).", "CO 2 RR on Cu +2 or C2 + x; C–C": "CO2RR on Cu+2 or C2 + x; C-C", "from 3\n-\nand 4+\n) of co 2": "from 3-and 4+) of co2", "abstract\n\u2028\x0b go  on": "go on", "Abstract in line": "Abstract in line", "pre‐\nÄrger but pre‐\närger": "pre‐ Ärger but pre‐ärger",
        "\n \n": "", "10 mA -2 and 5 mol −1, 7 %": "10 mA-2 and 5 mol−1, 7%", "H\n+\nH 2 O": "H+ H2 O", "ends.,  Next": "ends. Next", "": "", "no change": "no change", "wide\u00a0 \u2009 space": "wide space",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", one_line_abstract(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == cases


def plain_abstract(raw):
    """The rules of one_line_abstract() one after the other, over a list of words and line breaks."""
    import regex

    lines = [x for x in (" ".join(line.split()) for line in (raw or "").splitlines()) if x]
    if lines and lines[0].lower() in ("abstract", "abstract:", "abstract."):
        lines = lines[1:]
    text = ""
    for line in lines:
        sign = line.strip("0123456789")
        number = sign in ("", *notes.SIGNS) and line.count(sign or "x") <= 1 and (not sign or sign in (line[0], line[-1]))
        glued = number or line[0] in ",.;:)" or (text[-1:] in ("-", "‐", "‑", "‒", "–") and line[0].islower())
        text += line if glued or not text else " " + line
    for before, after in notes.GAPS:
        text = regex.sub(rf"({before})\s+(?={after})", r"\1", text)
    text = regex.sub(r"(?<=[a-z0-9)])\.,\s+(?=[A-Z])", ". ", regex.sub(r"\bC ?[–-] ?C\b", "C-C", text))
    return regex.sub(r"\s+([,.;:%)])", r"\1", text).replace("( ", "(").strip()


def test_abstracts_of_all_documents(spark, sf):
    from folioforge.functions.notes import one_line_abstract

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", one_line_abstract(F.col("text")).alias("c")).collect()
    assert all(r.c == plain_abstract(r.text) for r in docs)


def test_hash_migration_and_requests(spark):
    from folioforge.operators import library

    rows = [("a", None, None, "l", "s", 3, 0), ("b", "x", None, "l", "s", 1, 0), ("c", "x", "l", "l", "s", 2, 1), ("d", "x", "l", "l", "s", 2, 0), ("e", "x", "s", "l", "s", 2, 0), ("f", "x", None, "l", "s", 2, 0)]
    told = library.hash_migration(spark.createDataFrame(rows, "note_id string, block string, current string, legacy string, stable string, n_paths int, n_missing int")).collect()
    assert [r.status for r in told] == ["skipped_no_frontmatter", "skipped_single_pdf", "skipped_missing_pdf", "changed", "already_stable", "changed"]
    assert [r.aliases for r in told] == [None, None, None, ["l", "s"], ["s", "l"], ["l", "s"]]
    glued = spark.createDataFrame([("a" * 64 + "b" * 64,), (" " + "c" * 64,), ("",)], "value string")
    assert sorted(r.value[0] for r in library.ledger_append(glued, spark.createDataFrame([("a" * 64,), ("d" * 64,)], "value string")).collect()) == ["a", "b", "c", "d"]


def test_dense_top_k_keeps_ties_and_blocks(spark):
    import numpy as np

    from folioforge.operators import search

    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 3, (300, 6)).astype(float), rng.integers(0, 3, (25, 6)).astype(float)
    x[0] = q[1] = 0
    x[0, 0] = 1
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").where("id <> 299").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, vector array<double>")
    score = np.round(x @ q.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), 6)
    keep = [i for i in range(299) if x[i].any()]
    want = {(j, i, n + 1) for j in range(25) for n, i in enumerate([i for i in sorted(keep, key=lambda i: (-score[i, j], i)) if score[i, j] > 0][:4])}
    index = index.where(F.exists("vector", lambda v: v > 0))
    for block in (2000, 7):
        assert {(r.q, r.id, r["rank"]) for r in search.dense_top_k(index, "id", asked, "q", 4, block=block).collect()} == want
    assert search.dense_top_k(index, "id", asked.limit(0), "q", 4).count() == 0
