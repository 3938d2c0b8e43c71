"""Partial replacement: what is touched is written anew, the rest keeps its files."""

from pathlib import Path

import pytest

from folioforge.operators import index


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).glob("rows/*/*/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    own = index.Buckets(spark, str(tmp_path), "path string, n int", "path", "s1", buckets=16)
    own.rebuild(spark.createDataFrame([(f"p{i}", k) for i in range(200) for k in range(3)], "path string, n int"), "v1")
    before = files(tmp_path)
    new = spark.createDataFrame([("p1", 9), ("p2", 9), ("fresh", 1)], "path string, n int")
    touched = own.replace(new, spark.createDataFrame([("p1",), ("p2",), ("p3",), ("fresh",)], "path string"), "v2")
    rows = sorted(map(tuple, own.rows().collect()))
    assert rows == sorted([(f"p{i}", k) for i in range(200) if i not in (1, 2, 3) for k in range(3)] + [("p1", 9), ("p2", 9), ("fresh", 1)])
    assert 0 < len(touched) <= 4 and before <= files(tmp_path)
    read = {"/".join(f.split("/")[-3:-1]) for f in own.rows().inputFiles()}
    assert {x for x in read if x.startswith("version=v2")} == {f"version=v2/bucket={b}" for b in touched} and len(read) == 16


def test_emptied_buckets_other_schemas_and_foreign_rows(spark, tmp_path):
    own = index.Buckets(spark, str(tmp_path), "path string, n int", "path", "s1", buckets=4)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    own.rebuild(rows, "v1")
    own.replace(rows.limit(0), rows.select("path"), "v2")
    assert own.rows().count() == 0
    assert index.Buckets(spark, str(tmp_path), "path string, n int", "path", "s0", buckets=4).rows().count() == 0  # an empty index takes any schema
    own.replace(rows, rows.select("path"), "v3")
    with pytest.raises(ValueError):
        own.replace(rows, rows.select("path").where("path = 'a'"), "v4")
    other = index.Buckets(spark, str(tmp_path), "path string, n int", "path", "s2", buckets=4)
    with pytest.raises(ValueError):
        other.replace(rows, rows.select("path"), "v4")
    assert sorted(map(tuple, own.rows().collect())) == [("a", 1), ("b", 2)]
    other.rebuild(rows.limit(1), "v4")
    assert other.rows().count() == 1
    with pytest.raises(ValueError):
        own.rows()
