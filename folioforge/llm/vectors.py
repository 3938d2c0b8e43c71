"""Near-duplicate vectors by a pivot permutation index: inverted lists of nearest pivots, shared-pivot counts, exact cosines.

A vector is described by its nearest reference points in order. The first of them name its home; the lists of all of them hold its id,
its description and a sketch, and only in its home does the vector itself come along. In each list the pivots that two members
share are counted, pairs with enough are kept, and cosines come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_join, importable, map_arrow
from .components import connected_components
from .simhash import _forest

#: Members of a list that are compared in one piece; longer lists are dealt out in pairs of pieces.
TILE = 2048
#: Pairs a member, on average, up to which a piece gives the pairs it keeps; a denser piece gets its vectors instead.
DENSE = 32
#: Bits of a sketch, and how many may differ in a pair: at a cosine of 0.9 they differ by 18 and vary by 4, of unrelated vectors by 64 and 6.
SKETCH, MOST_BITS = 128, 38
#: For vectors of a length so rare that none was drawn: one list, one pivot.
LACKING = (1, 1, 1)


def unit(values) -> np.ndarray | None:
    """The vector in double precision with length one; None if it is null, zero or holds null or non-finite components."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (x / top) / np.linalg.norm(x / top)


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """unit() of usable vectors of one length, from their bytes."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, most_cosine: float, block: int = 256) -> np.ndarray:
    """The rows that stay if each goes that is nearer than most_cosine to an earlier one which stays."""
    kept = x[:0]
    for s in range(0, len(x), block):
        b = x[s : s + block]
        b = b[(b @ kept.T < most_cosine).all(axis=1)]
        close, stay = b @ b.T >= most_cosine, np.zeros(len(b), bool)
        for i in range(len(b)):
            stay[i] = not (close[i] & stay).any()
        kept = np.concatenate([kept, b[stay]])
    return kept


def nearest(x: np.ndarray, pivots: np.ndarray, near: int, block: int = 1024) -> np.ndarray:
    """The numbers of the near nearest pivots of each row, in order."""
    k, out = min(near, len(pivots)), []
    for s in range(0, len(x), block):
        close = x[s : s + block] @ pivots.T
        part = np.argpartition(-close, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(part, np.argsort(-np.take_along_axis(close, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, k), np.int32)


def named(pivots: np.ndarray) -> np.ndarray:
    """One number for the one or two pivots, in order, of each row."""
    x = pivots.astype(np.int64)
    return x[:, 0] if x.shape[1] == 1 else (x[:, 0] + 1) << 31 | x[:, 1]


def _meets(a: np.ndarray, b: np.ndarray, prefix: int) -> np.ndarray:
    """Whether the home of each row of a is among the pivots of the row of b."""
    return np.all([(a[:, k, None] == b).any(axis=1) for k in range(prefix)], axis=0)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, k, None] == b).any(axis=1).astype(np.int64) for k in range(a.shape[1]))


def calibrated(x: np.ndarray, pivots: np.ndarray, least_cosine: float, prefix: int, recall: float = 0.95, sizes: tuple[int, ...] = (10, 14, 20, 28), seed: int = 5) -> tuple[int, int]:
    """How many pivots describe a vector, and how many two must share: the fewest and then the most with which `recall` of pairs at exactly the link
    cosine, made by turning the probes x at random, meet in a list and are kept."""
    z = np.random.default_rng(seed).normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = least_cosine * x + np.sqrt(1 - least_cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    for near in sizes:
        a, b = nearest(x, pivots, near), nearest(y, pivots, near)
        if a.shape[1] <= prefix:
            return a.shape[1], 1
        met, shared = _meets(a, b, prefix) | _meets(b, a, prefix), _shared(a, b)
        if fits := [c for c in range(prefix, a.shape[1]) if (met & (shared >= c)).mean() >= recall]:
            return near, max(fits)
    return sizes[-1], prefix


def permutations(vectors: DataFrame, least_cosine: float = 0.9, members_a_pivot: int = 64, most_pivot_bytes: int = 1 << 26, prefix: int | None = None) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """(vec_id, dims, home, top, sketch, raw, same) of each row, and for each vector length how many pivots name a home, describe a vector, and must be shared.

    The reference points are vectors drawn by a hash, about one for each members_a_pivot rows, of most_pivot_bytes at most, and 600 more to calibrate by: a documented bound on what
    the driver sends. Where that bound is met lists would grow with the rows, and homes are named by two pivots, whose number is the
    square. Of pivots within one and a half times the link angle of each other only the first stays, so that a large group of near copies
    has few inside itself and its members keep them in common. Unusable vectors have null in all but vec_id.
    """
    spark = vectors.sparkSession
    double = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = "<f8" if double else "<f4"
    rows = vectors.count()
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = max(16, most_pivot_bytes // (8 * max(1, longest)))
    number = int(min(most, max(16, rows // members_a_pivot)))
    chosen = prefix or (1 if rows < 32 * members_a_pivot * most else 2)
    share, probes = min(1.0, number / max(1, rows)), min(1.0, 600 / max(1, rows))
    u = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.where("embedding is not null").select("embedding", u.alias("u")).where(F.col("u") < share + probes).distinct().collect()
    by_size: dict[int, tuple[list, list]] = {}
    for e, at in drawn:
        if (v := unit(e)) is not None:
            by_size.setdefault(len(v), ([], []))[at >= share].append(v)
    most_cosine = float(np.cos(min(np.pi, 1.5 * np.arccos(least_cosine))))
    sort = lambda x: np.stack(sorted(x, key=lambda v: v.tobytes()))
    pivots = {n: apart(sort(x), most_cosine) for n, (x, _) in by_size.items() if x}
    settings = {}
    for n, p in pivots.items():
        asked = np.random.default_rng(n).normal(size=(600, n))
        asked = sort(by_size[n][1]) if len(by_size[n][1]) >= 100 else asked / np.linalg.norm(asked, axis=1, keepdims=True)
        own = min(chosen, len(p))
        settings[n] = (own, *calibrated(asked, p, least_cosine, own))
    sent = spark.sparkContext.broadcast((pivots, settings))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, settings = sent.value
        names = ["vec_id", "dims", "home", "top", "sketch", "raw", "same"]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            groups: dict[int, tuple[list, list]] = {}
            lacking = []
            for i, e in enumerate(b.column(1).to_pylist()):
                if unit(e) is None:
                    lacking.append(i)
                else:
                    g = groups.setdefault(len(e), ([], []))
                    g[0].append(i)
                    g[1].append(np.asarray(e, kind).tobytes())
            if lacking:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lacking)), *[pa.nulls(len(lacking), t) for t in types]], names)
            for n, (places, raw) in groups.items():
                x = units(raw, kind)
                own, near, _ = settings.get(n, LACKING)
                top = nearest(x, pivots.get(n, np.eye(1, n)), near)
                signs = np.packbits(x @ np.random.default_rng(n).normal(size=(n, SKETCH)) > 0, axis=1)
                home = named(np.sort(top[:, :own], axis=1))
                columns = [[n] * len(raw), home, list(top), [s.tobytes() for s in signs], raw, [hashlib.blake2b(r, digest_size=16).digest() for r in raw]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_arrow(vectors.select("vec_id", "embedding"), order, f"vec_id {id_kind}, dims int, home long, top array<int>, sketch binary, raw binary, same binary"), settings


def classes(indexed: DataFrame) -> DataFrame:
    """(node, same, least, copies, dims, home, top, sketch, raw): one row for the copies of a vector, numbered, with the smallest of their ids and their number.

    A vector that a third of all rows hold is then one member of its lists, not a square of pairs.
    """
    whole = indexed.where("same is not null")
    one = whole.groupBy("same", "dims", "home", "top", "sketch", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return one.select(F.monotonically_increasing_id().alias("node"), "same", "least", "copies", "dims", "home", "top", "sketch", "raw")


def _dealt(members: DataFrame, total: int) -> DataFrame:
    """members (dims, key, node, ...) with i, j and piece: the pairs of pieces of its list that a member takes part in."""
    named = members.withColumn("list", F.struct("dims", "key"))
    sizes = named.groupBy("list").count().where("count > 1")
    full = hot_join(named, sizes, "list", F.col("count"), total).drop("list").withColumn("pieces", F.ceil(F.col("count") / TILE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    return full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other")).drop("other", "pieces", "count")


def _tallied(top: np.ndarray, home: np.ndarray, asked: np.ndarray, least: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked row, any row) that share `least` pivots or more, by adding up the postings of each asked row's pivots."""
    n, near = top.shape
    flat = top.ravel()
    by = np.argsort(flat, kind="stable")
    values, begin = np.unique(flat[by], return_index=True)
    size, rows = np.diff(np.append(begin, len(flat))), by // near
    place = np.searchsorted(values, top[asked])
    for s in range(0, len(asked), block):
        p = place[s : s + block].ravel()
        count = size[p]
        who = np.repeat(np.repeat(np.arange(len(place[s : s + block])), near), count)
        at = np.repeat(begin[p] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(who * n + rows[at], minlength=len(place[s : s + block]) * n).reshape(-1, n)
        a, b = np.nonzero(shared >= least)
        yield asked[s + a], b


def _kept(f: pd.DataFrame, settings: dict[int, tuple[int, int, int]], home_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a piece's rows that share enough pivots, each from one list only: within a home, or between one that is at home and one that is not."""
    own, _, least = settings.get(int(f["dims"].iloc[0]), LACKING)
    top, piece = np.stack(f["top"].to_numpy()), f["piece"].to_numpy()
    home = f["home"].to_numpy()
    crossed = bool(f["i"].iloc[0] != f["j"].iloc[0])
    key = f["key"].iloc[0]
    at_home = home == key
    sorted_home = np.sort(top[:, :own], axis=1)
    for a, b in _tallied(top, home, np.flatnonzero(at_home), least):
        ok = (at_home[b] & (a < b)) if home_only else ~at_home[b]
        if crossed:
            ok &= piece[a] != piece[b]
        a, b = a[ok], b[ok]
        if not home_only and len(a):
            # The list of b's home gives the pair too if a stands in it; the smaller home gives it.
            twice = _meets(sorted_home[b], top[a], own) & (home[b] < key)
            a, b = a[~twice], b[~twice]
        if len(a):
            yield a, b


def _verified(f: pd.DataFrame, settings, kind: str, least_cosine: float, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    x = units(f["raw"].tolist(), kind)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, c in _kept(f, settings, home_only):
        for s in range(0, len(r), 1 << 16):
            ok = np.einsum("ij,ij->i", x[r[s : s + (1 << 16)]], x[c[s : s + (1 << 16)]]) >= least_cosine
            a.append(r[s : s + (1 << 16)][ok])
            b.append(c[s : s + (1 << 16)][ok])
    return np.concatenate(a), np.concatenate(b)


def _told(f: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(a, b, n): with b null the number n of partners of a, copies counted; else links of a spanning forest."""
    nodes, copies = f["node"].to_numpy(), f["copies"].to_numpy()
    n = (np.bincount(a, copies[b], len(f)) + np.bincount(b, copies[a], len(f))).astype(np.int64)
    label, linked = _forest(len(f), a, b), np.flatnonzero(n)
    tied = np.flatnonzero(label != np.arange(len(f)))
    return pd.DataFrame({"a": np.concatenate([nodes[linked], nodes[tied]]), "b": pd.array([None] * len(linked) + nodes[label[tied]].tolist(), dtype="Int64"), "n": np.concatenate([n[linked], np.zeros(len(tied), np.int64)])})


def links(distinct: DataFrame, settings: dict[int, tuple[int, int, int]], kind: str, least_cosine: float = 0.9) -> DataFrame:
    """(a, b, n) of classes(), as _told() gives them.

    Pairs of one home are counted and verified there. Pairs of two homes are counted in lists of ids, descriptions and sketches: what is left goes
    on as pairs, and each fetches its two vectors. Where a piece keeps more than DENSE pairs a member, its members go on instead and get their
    vectors, so that the rows passed on grow with the members and not with their square.
    """
    spark = distinct.sparkSession
    importable(spark)
    keep, rows = "a long, b long, n long", distinct.count()
    at_home = _dealt(distinct.select("node", "dims", F.col("home").alias("key"), "home", "top", "copies", "raw"), rows)
    within = at_home.groupBy("dims", "key", "i", "j").applyInPandas(lambda f: _told(f, *_verified(f, settings, kind, least_cosine, True)), keep)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops, dims = b.column("top").to_pylist(), b.column("dims").to_pylist()
            own = [named(np.array([sorted(c) for c in combinations(t, settings.get(n, LACKING)[0])])) for t, n in zip(tops, dims, strict=True)]
            number = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(number)) for c in b.columns], pa.array(np.concatenate(own))], [*b.schema.names, "key"])

    members = map_arrow(distinct.select("node", "dims", "home", "top", "sketch"), listed, "node long, dims int, home long, top array<int>, sketch binary, key long")
    across = _dealt(checkpoint(members), rows * max((near for _, near, _ in settings.values()), default=1))

    def tally(f: pd.DataFrame) -> pd.DataFrame:
        nodes, sketch = f["node"].to_numpy(), np.frombuffer(b"".join(f["sketch"]), np.uint64).reshape(len(f), -1)
        a, b, number = [], [], 0
        for r, c in _kept(f, settings, False):
            ok = np.bitwise_count(sketch[r] ^ sketch[c]).sum(axis=1) <= MOST_BITS
            a.append(nodes[r[ok]])
            b.append(nodes[c[ok]])
            number += int(ok.sum())
            if number > DENSE * len(f):
                return pd.DataFrame({"a": nodes, "b": pd.array([None] * len(f), dtype="Int64"), "key": f["key"], "i": f["i"], "j": f["j"], "piece": f["piece"]})
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        return pd.DataFrame({"a": a, "b": pd.array(b, dtype="Int64"), "key": -1, "i": -1, "j": -1, "piece": -1})

    left = checkpoint(across.groupBy("dims", "key", "i", "j").applyInPandas(tally, "a long, b long, key long, i int, j int, piece int"))
    carried = distinct.select("node", "dims", "home", "top", "copies", "raw")
    dense = left.where("b is null").join(carried, left.a == carried.node).select("node", "dims", "key", "i", "j", "piece", "home", "top", "copies", "raw")
    between = dense.groupBy("dims", "key", "i", "j").applyInPandas(lambda f: _told(f, *_verified(f, settings, kind, least_cosine, False)), keep)
    one = left.where("b is not null").select("a", "b").join(distinct.select(F.col("node").alias("a"), F.col("copies").alias("ca"), F.col("raw").alias("ra")), "a")
    pairs = one.join(distinct.select(F.col("node").alias("b"), F.col("copies").alias("cb"), F.col("raw").alias("rb")), "b").select("a", "b", "ca", "cb", "ra", "rb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = b.column("ra").to_pylist(), b.column("rb").to_pylist()
            sizes = np.array([len(r) for r in ra], np.int64)
            ok = np.zeros(len(b), bool)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                ok[at] = np.einsum("ij,ij->i", units([ra[k] for k in at], kind), units([rb[k] for k in at], kind)) >= least_cosine
            kept = b.filter(pa.array(ok))
            a, c = kept.column("a"), kept.column("b")
            nothing = pa.nulls(len(kept), pa.int64())
            zero = pa.array(np.zeros(len(kept), np.int64))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, c, a]), pa.concat_arrays([nothing, nothing, c]), pa.concat_arrays([kept.column("cb"), kept.column("ca"), zero])], ["a", "b", "n"])

    return within.unionByName(between).unionByName(map_arrow(pairs, verify, keep))


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.9, **index) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row. index: arguments of permutations().

    Rows are judged, not ids: a repeated vec_id stands for as many vectors, a row without one links as any other and is not kept if something
    that has an id is linked with it. component_id is the smallest vec_id reachable, null where no row that is reached has one. Unusable vectors
    link with nothing and are kept.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    described, settings = permutations(vectors, least_cosine, **index)
    indexed = checkpoint(described)
    distinct = checkpoint(classes(indexed))
    found = checkpoint(links(distinct, settings, kind, least_cosine))
    numbers = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    told = distinct.select("node", "same", "least", "copies").join(numbers, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = told.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("parts"))
    rows = indexed.count()
    told = hot_join(told, heads, "component", F.col("parts"), rows).select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "head", "copies")
    linked = hot_join(indexed.where("same is not null").select("vec_id", "same"), told, "same", F.col("copies"), rows).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("head").alias("component_id"))
    alone = indexed.where("same is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
