"""One key with most rows, clashing column names, and the coupled constraints of the mix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import chat, common, components, mixing, simhash, urls


@pytest.fixture
def hot(monkeypatch):
    """Keys of more than a hundredth of the rows count as hot, so small tables have some."""
    monkeypatch.setattr(common, "HOT", 100)


@pytest.mark.parametrize("most", [urls.MAX_BLOCKS, 0])
def test_one_body_on_most_addresses_and_one_short_rule(spark, hot, monkeypatch, most):
    monkeypatch.setattr(urls, "MAX_BLOCKS", most)
    rows = [(i, f"http://h{i % 40}.com/p{i}", "gone" if i % 3 else f"body {i}") for i in range(3000)] + [(9000, None, None), (9001, "http://x.net/es/1", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    rules = spark.createDataFrame([("com", "/", "allow"), ("h1.com", "/p1", "block"), ("net", "/es/", "block")], "host string, path string, verdict string")
    listed = urls.mirror_list(pages)
    served = [(f"h{i % 40}.com", f"/p{i}") for i in range(3000) if i % 3] + [("x.net", "/es/1")]
    assert {(r.host, r.path) for r in listed.collect()} == set(served) - {min(served, key=lambda x: x[0] + x[1])}
    got = {r.page_id: (r.rule, r.verdict) for r in urls.block_listed(urls.judge(pages, rules), listed).collect()}
    want = {i: ("h1.com/p1", "block") if i % 40 == 1 and f"p{i}".startswith("p1") else ("com/", "allow") for i in range(3000)} | {9000: (None, "allow"), 9001: ("net/es/", "block")}
    assert got == want


@pytest.mark.parametrize("three", [simhash.MOST_THREE, 0])
def test_one_bucket_with_most_fingerprints(spark, hot, monkeypatch, three):
    """With sets of three and of four positions."""
    monkeypatch.setattr(simhash, "MOST_THREE", three)
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(8)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 40, 900)} | {int(rng.integers(0, 1 << 40)) ^ (1 << int(b)) for b in rng.integers(0, 64, 50)} | {(5 << 40) + k for k in range(60)})
    got = {r.id: r.component for r in components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    label = {x: x for x in fps}
    near = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    assert got == {x: label[x] for pair in near for x in pair} and near


def test_thousands_of_turns_without_a_number(spark, hot, monkeypatch):
    monkeypatch.setattr(chat, "PART", 16)
    rows = [(1, None, "user", "same")] * 3000 + [(1, None, "user", f"t{i:04}") for i in range(500)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    pos = sorted(map(tuple, chat.numbered(df).collect()))
    want = [(1, k + 1, "user", t) for k, t in enumerate(["same"] * 3000 + [f"t{i:04}" for i in range(500)])] + [(2, 1, "user", "a"), (2, 2, "user", "a"), (2, 3, "assistant", "b"), (3, 1, "user", "a"), (3, 2, "user", "a")]
    assert pos == sorted(want)
    got = chat.render(df).collect()
    assert {(r.conv_id, r.n_turns, r.n_same) for r in got} == {(1, 3500, 1), (2, 3, 1)}
    assert "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1).count("same") == 3000


def test_columns_with_the_names_of_the_pipelines_own(spark, tmp_path):
    rows = [(i, f"word{i} " * (5 + i % 30), f"s{i % 3}", f"mine{i}", i, f"c{i}", i) for i in range(40)] + [(None, "twin text here", "s1", "t", 1, "c", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _digest string, Size int, copy string, row int")
    once = simhash.one_of_each(docs)
    assert once.columns == docs.columns and sorted(map(repr, map(tuple, once.collect()))) == sorted({repr(r) for r in rows})
    mixed = corpus_pipeline.mixture(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["doc_id", "text", "source", "_digest", "own_Size", "own_copy", "row", "size", "source_size", "target", "copies", "copy"]
    assert {r.own_copy for r in back.collect()} <= {r[5] for r in rows} and all(r.copy <= r.copies for r in back.collect())


def test_multipliers_differ_by_class_and_the_gradient_vanishes(spark):
    """Two sources of other sizes: without the second constraints a source's documents would all have one rate."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30) if i % 4 else rng.integers(300, 3000))), "a" if i % 4 else "b", None) for i in range(600)] + [(1000 + i, "w " * int(rng.integers(1, 900)), "c", None) for i in range(300)]
    docs = spark.createDataFrame([(*r[:3],) for r in rows], "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    classes = sized.groupBy(mixing.source_key(F.col("source")).alias("key"), mixing.size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    goals = mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    cells = mixing._cells(classes).join(goals.select(mixing.source_key(F.col("source")).alias("key"), "target"), "key")
    found = mixing.solve(cells)
    assert found.gap < 1e-8 and 1 < found.steps < 30 and np.ptp(found.mu) > 1e-3
    kept, free = [], []
    for mu, out in ((found.mu, kept), (np.zeros(mixing.OCTAVES), free)):
        got = np.zeros(mixing.OCTAVES)
        for r in cells.collect():
            w = np.array(r.words)
            rate = mixing.tilted(w[None], np.array([r.target]), mu)[0]
            assert np.isclose((w * rate).sum(), r.target, rtol=1e-9)
            got += w * rate
        words = sum(np.array(r.words) for r in cells.collect())
        out.append(np.abs(got / got.sum() - words / words.sum()).sum())
    assert kept[0] < 0.9 * free[0]
    rates = {(r.source, r["size"].bit_length()): r.rate for r in mixing.mix(docs).collect()}
    assert any(len({v for (s, _), v in rates.items() if s == source}) > 1 for source in "abc")


def test_mixing_deals_small_tables_to_few_tasks(spark, monkeypatch):
    """With many shuffle partitions, sources and classes take a task each step, not as many as there are partitions; the result is that of few partitions, and of tables too large for a task."""
    rows = [(i, "w " * (1 + i * 7 % 300), f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    tracker, got = spark.sparkContext.statusTracker(), []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (4, 97):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.sparkContext.setJobGroup(f"mixing{n}", "")
            got.append(sorted(map(tuple, mixing.shares(docs).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.sparkContext.setJobGroup("mixing", "")
        for module in (common, mixing):
            monkeypatch.setattr(module, "TASK_ROWS", 2)
        got.append(sorted(map(tuple, mixing.shares(docs).collect())))
        stages = {s for j in tracker.getJobIdsForGroup("mixing97") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    ran = [i for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert sum(i.numCompletedTasks for i in ran) < 20 * 97


def test_few_documents_of_unlike_sizes_meet_their_targets(spark):
    """A source of five to eight documents takes about as near its target as any numbers of copies could."""
    rng = np.random.default_rng(21)
    sizes = {f"s{i:02}": [int(x) for x in np.exp(rng.uniform(3, 7.5, rng.integers(5, 9)))] for i in range(24)} | {"t0": [4000, 30, 20, 10], "t1": [3000, 2000, 900, 900]}
    rows = [(100 * k + i, "w " * n, s) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    taken, goal = dict.fromkeys(sizes, 0), {}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.shares(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source], goal[r.source] = taken[r.source] + r.taken, r.target
    for s, own in sizes.items():
        reached = {0}
        for n in own:
            reached = {x + c * n for x in reached for c in (0, 1, 2)}
        best = min(abs(x - goal[s]) for x in reached)
        assert abs(taken[s] - goal[s]) <= best + max(0.03 * goal[s], min(own)), (s, own, goal[s], taken[s], best)


def test_no_document_is_taken_more_than_twice(spark):
    """What a large document misses doesn't make a third copy of small ones that have two."""
    rows = [("a", 638, 1, 1000, 1020, 1440.0, 1.4), ("a", 221, 2, 20, 1020, 1440.0, 2.0), ("b", 600, 1, 700, 700, 700.0, 1.0), ("b", 0, 4, 0, 700, 700.0, 0.5)]
    counted = spark.createDataFrame(rows, "key string, class int, n long, words long, source_size long, target double, rate double")
    assert sorted(map(tuple, mixing._dealt(counted).collect())) == [("a", 221, 2, 0), ("a", 638, 1, 0), ("b", 0, 0, 2), ("b", 600, 1, 0)]
