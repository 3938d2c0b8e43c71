"""Compares a query's rows with its SQL's, columns by name, order aside."""

from pathlib import Path

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (len(bad), bad[:2])
