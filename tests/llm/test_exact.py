"""Exact duplicates against a plain version."""

import hashlib
import re
from collections import defaultdict

import pytest

from folioforge.llm import exact


def plain(rows):
    """Sorted (doc_id, keep_id, group_size, kept, digest) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    out = []
    for s, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, s) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


ROWS = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (None, "a b"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\n\n"), (None, "only"), (None, "only"), (9, "twice"), (9, "twice"), (10, "x y"), (11, "x y"), (12, "w " * 200_000), (13, "w\n" * 200_000)]


def test_equal_texts(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, digest string, row int").repartition(3)
    assert sorted(map(tuple, exact.duplicates(docs).collect()), key=repr) == plain(ROWS)
    assert exact.duplicates(docs.limit(0)).count() == 0
    kept = exact.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, _, _, k, _ in plain(ROWS) if k)
    assert exact.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [exact.MAX_BLOCKS, 0])
def test_one_text_on_a_third_of_all_rows(spark, monkeypatch, most):
    """Both ways to meet the filter."""
    monkeypatch.setattr(exact, "MAX_BLOCKS", most)
    rows = [(i, "everywhere" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    assert sorted(map(tuple, exact.duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()), key=repr) == plain(rows)


def test_rows_alone_pass_straight_through(spark):
    """The filter names all that repeat, and few others."""
    rows = spark.range(20_000).selectExpr("cast(case when id < 1000 then id % 100 else id end as string) as digest")
    asked = exact.may_repeat(rows, *exact.repeated_filter(rows))
    assert asked.where("not maybe and cast(digest as int) < 100").count() == 0
    assert asked.where("maybe and cast(digest as int) >= 100").count() < 1000
