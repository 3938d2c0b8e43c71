"""Retrieval indexes: pruned searches against plain ones, and what they leave unread."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioforge.jobs import retrieval_catalogue
from folioforge.operators import cells, lexical, search


def plain_bm25(docs, queries, k, grams=lambda t: [t[i : i + 3] for i in range(len(t) - 2)]):
    tfs = {i: Counter(grams((t or "").lower())) for i, t in docs}
    average = sum(sum(c.values()) for c in tfs.values()) / len(docs)
    df = Counter(t for c in tfs.values() for t in c)
    out = []
    for q, text in queries:
        scores = Counter()
        for t in set(grams(text.lower())):
            for i, c in tfs.items():
                if c[t]:
                    idf = math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    scores[i] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        best = sorted(((-round(s, 4), i) for i, s in scores.items()))[:k]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    return sorted(out)


def test_trigrams_find_chinese_and_formulas(spark, tmp_path):
    docs = [(1, "石墨烯薄膜的热导率测量"), (2, "Mechanische Eigenschaften von Fe2O3-Schichten"), (3, "LiFePO4 cathodes at 25 °C"), (4, None), (5, ""), (6, "ab"), (7, "氧化石墨烯的还原"), (8, "𝒳𝒴𝒵 maths")]
    asked = [(1, "石墨烯"), (2, "fe2o3"), (3, "lifepo4 CATHODES"), (4, "zzz"), (5, ""), (6, "𝒳𝒴𝒵")]
    lexical.write(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", str(tmp_path / "a"))
    asks = spark.createDataFrame(asked, "item_id long, text string")
    got = sorted((r.item_id, r.doc, r["rank"]) for r in lexical.search(lexical.load(spark, str(tmp_path / "a")), asks, "item_id", 3).collect())
    assert got == plain_bm25(docs, asked, 3) and {i for q, i, _ in got if q == 1} == {1, 7} and {q for q, _, _ in got} == {1, 2, 3, 6}
    lexical.write(spark.createDataFrame([], "doc_id long, text string"), "doc_id", str(tmp_path / "b"))
    assert lexical.search(lexical.load(spark, str(tmp_path / "b")), asks, "item_id", 3).count() == 0


def test_scan_gives_what_the_index_does_and_writes_nothing(spark, sf, monkeypatch):
    """In one block of queries and in many; the texts are neither written nor shuffled, and the query leaves no index."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_bm25([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    for cells in (4_000_000, 20_000, 1):
        found = lexical.scan(docs, items, "doc_id", "item_id", 3, cells=cells)
        assert sorted((r.item_id, r.doc, r["rank"]) for r in found.collect()) == want
    small = spark.createDataFrame([(1, "石墨烯薄膜"), (2, "Fe2O3"), (3, None), (4, ""), (5, "ab"), (6, "石墨烯薄膜"), (None, "fe2o3")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "石墨烯"), (2, "fe2o3"), (3, "zzz"), (4, ""), (5, None)], "item_id long, text string")
    assert sorted((r.item_id, r.doc, r["rank"]) for r in lexical.scan(small, asks, "doc_id", "item_id", 3).collect()) == [(1, 1, 1), (1, 6, 2), (2, 2, 1)]
    for few in (small.limit(0), small):
        assert lexical.scan(few, asks.where("item_id > 2"), "doc_id", "item_id", 3).count() == 0
    monkeypatch.delattr(lexical, "write")
    assert retrieval_catalogue.trigram_search(spark, sf).count() > 0 and retrieval_catalogue.trigram_hybrid(spark, sf).count() > 0


def test_pruned_search_is_exact_and_leaves_postings_unread(spark, sf, tmp_path):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    lexical.write(docs, "doc_id", str(tmp_path))
    index = lexical.load(spark, str(tmp_path))
    got = sorted((r.item_id, r.doc, r["rank"]) for r in lexical.search(index, items, "item_id", 3).collect())
    assert got == plain_bm25([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    asked = lexical.asked_terms(index, items, "item_id")
    split = lexical.split_terms(asked, lexical.floors(index, asked, 3))
    read, full = split.agg(F.sum(F.when(F.col("essential"), F.col("df"))), F.sum("df")).first()
    print("postings", read, full)
    assert read < 0.5 * full


def test_cells_find_the_nearest_and_read_few_folders(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    cells.write(rows, "vec_id", str(tmp_path))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    x = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows.collect()}
    want = {q: set(sorted(x, key=lambda i: (-round(float(x[q] @ x[i]), 6), i))[:10]) for q in x if q % 100 == 0}
    for probes, exact, least in ((None, False, 0.95), (1, True, 1.0)):
        got = {}
        for r in cells.search(spark, str(tmp_path), asked, "q", 10, probes, exact).collect():
            got.setdefault(r.q, set()).add(r.id)
        assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= least
    numbers, known = cells.load(spark, str(tmp_path))
    wanted = [r.cell for r in cells._probing(cells.directed(asked.limit(2), "q").selectExpr("id as q", "x", "cast(null as double) as floor"), numbers, known, 2).select("cell").distinct().collect()]
    read = cells.members(spark, str(tmp_path), wanted)
    assert {int(re.search(r"cell=(\d+)", r[0])[1]) for r in read.select(F.input_file_name()).distinct().collect()} == set(wanted) and 0 < len(wanted) <= 4 < len(numbers)
    assert sum(known.size) == len(x)


def test_cells_of_clustered_vectors_read_a_small_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cells.write(rows, "vec_id", str(tmp_path))
    numbers, known = cells.load(spark, str(tmp_path))
    assert known.probes <= len(numbers) // 4
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for r in cells.search(spark, str(tmp_path), rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "q"), "q", 10).collect():
        total += 1
        hits += r.id in set(np.argsort(-np.round(unit @ unit[r.q], 6), kind="stable")[:10].tolist())
    assert hits >= 0.95 * 400 and total == 400


def test_cells_of_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1.0, 1.0]), (7, []), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells.write(df, "vec_id", str(tmp_path / "a"))
    got = [tuple(r)[:3] for r in cells.search(spark, str(tmp_path / "a"), df.select(F.col("vec_id").alias("q"), "embedding"), "q", 2, 1, True).orderBy("q", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 5, 1.0), (5, 1, 1.0), (5, 5, 1.0), (6, 6, 1.0), (6, 1, 0.707107)]


def test_cells_in_several_partitions_lose_no_member(spark, tmp_path):
    """The members' cells and the queries' meet in the same partition when there are several."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cells.write(rows, "vec_id", str(tmp_path), cells=30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cells.search(spark, str(tmp_path), rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q"), "q", 5, 1, True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, i, r + 1) for q in range(0, 900, 50) for r, i in enumerate(sorted(range(900), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5])]
    assert sorted((r.q, r.id, r["rank"]) for r in got) == sorted(want)


def test_token_overlap_by_rare_tokens(spark):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{k}" for k in np.unique(rng.zipf(1.3, 60) % 80))) for i in range(200)] + [(900, None), (901, "")]
    quotes = [(i, docs[i * 3][1].rsplit(" ", int(rng.integers(1, 4)))[0] + " rare" * (i % 2)) for i in range(30)] + [(77, ""), (78, None), (79, "w1"), (80, "absent words")]
    bag = lambda t: set((t or "").split())
    want = sorted((q, d, len(bag(a) & bag(b)), len(bag(a))) for q, a in quotes for d, b in docs if bag(a) and len(bag(a) & bag(b)) >= 0.9 * len(bag(a)))
    got = search.token_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string"), "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_word_index_agrees_with_all_postings(spark, sf, tmp_path):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    lexical.write(docs, "doc_id", str(tmp_path), lexical.word_counts)
    got = lexical.search(lexical.load(spark, str(tmp_path)), items, "item_id", 5, lexical.word_counts)
    whole = search.bm25(docs, items, "doc_id", "item_id").withColumn("score", F.round("score", 4))
    want = search.ranked(whole, "item_id", [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
