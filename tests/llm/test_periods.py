"""Runs against a plain search, LCE queries against a plain walk."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from folioforge.llm import periods


def plain_runs(x):
    """All runs of a list by trying each period at each place."""
    found = set()
    for q in range(1, len(x) // 4 + 1):
        s = 0
        while s + q < len(x):
            e = s
            while e + q < len(x) and x[e] == x[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                found.add((s, e + q - s, q))
            s = e + 1
    smallest = {}
    for s, n, q in sorted(found):
        smallest.setdefault((s, n), q)
    return sorted((s, n, q) for (s, n), q in smallest.items())


def plain(i, text):
    words = (text or "").encode().split()
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(kept))


def awkward(rng, kind):
    n = int(rng.integers(0, 150))
    if kind == 0:
        return rng.integers(0, 2, n)
    if kind == 1:
        return np.zeros(n, int)
    if kind == 2:
        return np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 9)) for _ in range(4)])
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return np.array(b[:n], int)
    return rng.integers(0, 40, n)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    texts = [awkward(rng, k % 5).astype(np.int64) for k in range(25)]
    for x, got in zip(texts, periods.runs(texts), strict=True):
        assert list(map(tuple, got.tolist())) == sorted(plain_runs(x.tolist()), key=lambda r: (r[0], r[2]))


def test_grammar_answers_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = periods._joined([np.tile(rng.integers(0, 3, 17), 9), rng.integers(0, 2, 400), np.zeros(60, np.int64)])
    g = periods.Grammar(x)
    assert len(g.levels) > 4 and len(g.levels[-1]) <= periods.FEW
    i, j = rng.integers(1, len(x) - 1, 3000), rng.integers(1, len(x) - 1, 3000)
    i, j = i[i != j], j[i != j]

    def walk(a, b, step):
        k = 0
        while x[a + k * step - (step < 0)] == x[b + k * step - (step < 0)]:
            k += 1
        return k

    for step in (1, -1):
        assert g.agree(i, j, step).tolist() == [walk(a, b, step) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    rows += [(None, "a b " * 9), (7, None), (7, ""), (20, " \n"), (20, "x " * 50), (21, "And the\n" * 30 + "end"), (22, "a a a b " * 8)] + [(i, f"w{i} " * 4 + "u v w x y z " * 6) for i in range(100, 160)]
    got = periods.find(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, period int").repartition(3), plant=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert periods.find(docs.limit(0)).count() == 0


def test_collapsed_text(spark):
    row = periods.find(spark.createDataFrame([(1, "go " + "tick tock " * 10 + "stop")], "doc_id long, text string"), keep_text=True).first()
    assert (row.start, row.length, row.period, row.exponent_milli, row.text) == (1, 20, 2, 10000, "go tick tock stop")


@pytest.mark.parametrize("make", [lambda rng, n: ["a"] * n, lambda rng, n: [f"w{k % 4001}" for k in range(n)], lambda rng, n: [f"w{k}" for k in rng.integers(0, 9, n)], lambda rng, n: [f"w{k}" for k in rng.integers(0, 90_000, n)]])
def test_very_long_texts_take_seconds(make):
    words, x = periods.numbered(" ".join(make(np.random.default_rng(1), 400_000)).encode())
    began = time.perf_counter()
    found = periods.runs([x])[0]
    assert time.perf_counter() - began < 60
    assert (periods.dropped(found, len(x)).sum() > 300_000) == (len(set(words[:8000])) in (1, 4001))
