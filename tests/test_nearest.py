"""The search over all pairs in tiles: against plain sums, with copies, ties, keys and odd vectors; and the queries that rest on it."""

import functools
import math
import operator

import numpy as np
import pytest

from folioforge.jobs import catalogue, library_catalogue, notes_catalogue, records_catalogue  # noqa: F401
from folioforge.operators import search

#: Queries that make no row a pair.
TILED = [
    "topk_per_query",
    "track_metrics",
    "retrieval_metrics",
    "retrieval_timeline",
    "known_paper",
    "full_read",
    "collected_keys",
    "pool_coverage",
    "macro_average",
    "retrieval_methods",
    "angle_pool",
    "rerank",
]


def plain(rows, asked, k, on=False, squared=False, itself=False):
    """By sums in the order of the components; what is no number comes last, null after it."""
    total = lambda parts: functools.reduce(operator.add, parts, 0.0)  # sum() corrects its rounding
    dot = lambda a, b: total(x * y for x, y in zip(a, b, strict=True))
    out = []
    for q, y, key in asked:
        best = []
        for i, x, label in rows:
            if (i == q and not itself) or (on and label != key):
                continue
            if x is None or y is None:
                best.append((2, 0.0, i))
                continue
            n = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
            d = total((a - b) * (a - b) for a, b in zip(x, y, strict=True)) if squared else 1 - dot(x, y) / n if n else math.nan
            best.append((1, 0.0, i) if math.isnan(d) else (0, d, i))
        out += [(q, i, [d, None, None][kind] if kind != 1 else "nan", r + 1) for r, (kind, d, i) in enumerate(sorted(best)[:k])]
    return sorted(out, key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("on, squared, itself, cells", [(False, False, False, 2_000_000), (True, False, False, 2_000_000), (True, True, False, 60), (False, True, True, 60), (False, False, True, 1)])
def test_nearest_is_that_of_plain_sums(spark, on, squared, itself, cells):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 5)), rng.integers(-1, 2, (80, 5))]).astype(np.float32)
    rows = [(i, x[i % 140].tolist(), i % 4) for i in range(400)]  # copies, and many equal distances
    rows[7], rows[8], rows[11] = (7, [0.0] * 5, 3), (8, None, 0), (11, [0.0] * 5, 3)
    rows += [(500 + i, [1.0, float(i), 0.0, 0.0, 0.0], 9) for i in range(3)]  # fewer than k
    asked = [(i, v, key) for i, v, key in rows if i % 25 == 0 or i in (7, 8, 501)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = search.nearest(index, spark.createDataFrame(asked, "query_id long, q array<float>, key int"), 6, on=("label", "key") if on else None, squared=squared, itself=itself, cells=cells)
    got = sorted(((r.query_id, r.vec_id, "nan" if r.distance is not None and math.isnan(r.distance) else r.distance, r["rank"]) for r in found.collect()), key=lambda r: (r[0], r[3]))
    assert got == plain(rows, asked, 6, on, squared, itself)
    assert {"label", "key"} < set(found.columns) and all(r.label == rows[r.vec_id][2] for r in found.where("vec_id < 400").collect())


def test_nearest_of_nothing(spark):
    index = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>")
    for a, b in ((index, asked), (index.limit(0), asked), (index, asked.where("false"))):
        assert search.nearest(a, b, 3).count() == 0


@pytest.mark.parametrize("name", TILED)
def test_pairs_are_no_rows(spark, sf, name):
    df = (catalogue.queries() | notes_catalogue.Q)[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
