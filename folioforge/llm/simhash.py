"""SimHash near duplicates: fingerprints of word shingles, joined by an inverted index on positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_join, importable, map_arrow, shuffle_tasks
from .components import connected_components

#: Fingerprints of a bucket that are compared in one piece; a larger bucket is dealt out in pairs of pieces.
TILE = 2048
#: Distinct fingerprints up to which sets of three byte positions (24 bits) name a bucket; beyond, all 70 sets of four (32 bits) do.
MOST_THREE = 1 << 24


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, hash_of = memoryview(joined), xxhash.xxh64_intdigest
        h = np.fromiter([hash_of(view[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(axis=0, dtype=np.int64) if len(part) > 255 else part.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null and empty texts have 0. One row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def index_keys(max_bits: int, width: int = 3) -> list[tuple[int, ...]]:
    """Sets of byte positions of which two fingerprints within max_bits bits share at least one whole set.

    max_bits differing bits touch that many of 8 bytes at most, so 8 - max_bits positional bytes match for certain.
    For 4 matches and sets of 3 positions, Turan's construction needs 20 of the 56 sets.
    """
    least = 8 - max_bits
    if least == 4 and width == 3:
        groups = ((0, 1, 2), (3, 4, 5), (6, 7))
        of = {p: g for g, ps in enumerate(groups) for p in ps}
        return [c for c in combinations(range(8), 3) if (n := [sum(of[p] == g for p in c) for g in range(3)]) and (max(n) == 3 or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)))]
    return list(combinations(range(8), min(width, least)))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within max_bits bits, as a spanning forest of each piece of a bucket.

    An inverted index maps sets of positional bytes to fingerprints: sets of three, or of four beyond MOST_THREE fingerprints, so that buckets stay small; either holds all pairs, with the same result. In a bucket the matching positional bytes of each pair are
    counted, pairs below the guaranteed number are dropped, and the rest are verified bit by bit. Only links of a
    forest leave a task, so a group of n copies gives about n rows and not n * n; what is reachable stays the same.
    """
    least = 8 - max_bits
    spark = fps.sparkSession
    importable(spark)
    distinct = checkpoint(fps.select("fp").distinct())
    keys = index_keys(max_bits, 3 if distinct.count() <= MOST_THREE else 4)

    def key(i: int, positions: tuple[int, ...]) -> str:
        mask = sum(255 << 8 * p for p in positions)
        mask = mask - (1 << 64) if mask >> 63 else mask
        return f"struct({i} as k, fp & {mask}L as v)"

    spread = distinct.selectExpr("fp", f"explode(array({', '.join(key(i, c) for i, c in enumerate(keys))})) as e").selectExpr("fp", "xxhash64(e.k, e.v) as bucket")
    sizes = checkpoint(spread.groupBy("bucket").count().where("count > 1"))
    full = hot_join(spread, sizes, "bucket", F.col("count"), distinct.count() * len(keys)).withColumn("pieces", F.ceil(F.col("count") / TILE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("bucket", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "fp")
    dealt = dealt.repartition(shuffle_tasks(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames):
            yield _linked(f, least, max_bits)

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _whole_groups(frames: Iterator[pd.DataFrame], at_least: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """Frames of sorted rows put together so that no (bucket, i, j) is cut."""
    held, rows = [], 0
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        rows += len(f)
        if rows >= at_least:
            all_rows = pd.concat(held, ignore_index=True)
            last = all_rows.iloc[-1]
            same = ((all_rows.bucket == last.bucket) & (all_rows.i == last.i) & (all_rows.j == last.j)).to_numpy()
            cut = len(all_rows) - int(same.sum())
            if cut:
                yield all_rows.iloc[:cut]
                all_rows = all_rows.iloc[cut:]
            held, rows = [all_rows], len(all_rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _linked(f: pd.DataFrame, least: int, max_bits: int) -> pd.DataFrame:
    fp = f.fp.to_numpy().view(np.uint64)
    octets = fp.view(np.uint8).reshape(-1, 8)
    piece, crossed = f.piece.to_numpy(), (f.i != f.j).to_numpy()
    fresh = np.concatenate(([True], (np.diff(f.bucket.to_numpy()) != 0) | (np.diff(f.i.to_numpy()) != 0) | (np.diff(f.j.to_numpy()) != 0)))
    group = np.cumsum(fresh)
    a, b = [], []
    live = np.arange(len(f))
    for gap in range(1, len(f)):  # pairs at that distance in the sorted rows; no group is longer than two pieces
        live = live[live + gap < len(f)]
        live = live[group[live] == group[live + gap]]
        if not len(live):
            break
        x, y = live, live + gap
        tally = (octets[x] == octets[y]).sum(axis=1)
        ok = (tally >= least) & (~crossed[x] | (piece[x] != piece[y]))
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= max_bits
        a.append(x[ok])
        b.append(y[ok])
    if not a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    label = _forest(len(f), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(label != np.arange(len(f)))
    signed = f.fp.to_numpy()
    return pd.DataFrame({"a": signed[own], "b": signed[label[own]]}).drop_duplicates()


def _heads(docs: DataFrame, max_bits: int) -> DataFrame:
    """(fp, head, n) of (doc_id, fp): the least doc_id of each fingerprint's component, and its number of rows; one row for each fingerprint."""
    owners = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(links(owners, max_bits))
    named = owners.join(parts, owners.fp == parts.id, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("parts"))
    return hot_join(named, heads, "component", F.col("parts"), owners.count()).select("fp", "head", "n")


def near_duplicates(documents: DataFrame, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 hexadecimal digits, component_id the smallest doc_id reachable by links.

    Documents of one fingerprint are linked, texts without words among them. A group in which no row has a doc_id has a null
    component_id; rows that repeat a doc_id are judged each by its own text. One row for each row.
    """
    docs = checkpoint(fingerprints(documents))
    told = hot_join(docs, _heads(docs, max_bits), "fp", F.col("n"), docs.count())
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head").alias("component_id"))


#: Words of 64 bits of a wide fingerprint; its index holds SETS sets of three of its bytes, so 24 bits name a bucket.
LANES, SETS = 16, 128
#: Members of a bucket of which all pairs are compared at once.
SMALL = 32


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> bytes:
    """1024 bits: each is set if it is in over half of the distinct shingles' hashes, the XXH64 of which is mixed anew for each 64 bits; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * LANES)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    view, hash_of = memoryview(joined), xxhash.xxh64_intdigest
    h = np.unique(np.fromiter([hash_of(view[a:b]) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64, n))
    ones = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(h), 4096):
        x = h[k : k + 4096, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h)).tobytes()


def most_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which two texts count as similar: a standard deviation above what shingle sets of that Jaccard similarity differ by."""
    part = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * LANES * part + (64 * LANES * part * (1 - part)) ** 0.5)


def byte_sets(seed: int = 1) -> list[tuple[int, int, int]]:
    """SETS sets of three byte positions, taken off shuffled positions so that each is used about as often."""
    rng = np.random.default_rng(seed)
    deck = np.concatenate([rng.permutation(8 * LANES) for _ in range(-(-3 * SETS // (8 * LANES)))])
    return [tuple(int(p) for p in deck[3 * i : 3 * i + 3]) for i in range(SETS)]


def similar(owners: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b) of owners (node, wide), one row for each wide fingerprint: links between similar ones.

    The inverted index maps sets of positional bytes to nodes, and nodes alone in all their buckets go no further. In a bucket the positional bytes that
    two share are tallied, pairs far below what similar texts share are dropped, and the bits of the rest are compared. In a large bucket a member is compared
    with those that no link joins to it yet, so a group of near copies costs its size and not its square, and what is reachable stays the same. Only links
    of a forest leave a task. Approximate: two texts meet if a set of three bytes is equal in both.
    """
    spark = owners.sparkSession
    importable(spark)
    limit, octets = most_bits(similarity), 8 * LANES
    least = octets // 16
    keys = [f"xxhash64({k}, {', '.join(f'substring(wide, {p + 1}, 1)' for p in c)})" for k, c in enumerate(byte_sets())]
    spread = owners.selectExpr("node", f"explode(array({', '.join(keys)})) as bucket")
    sizes = checkpoint(spread.groupBy("bucket").count().where("count > 1"))
    full = hot_join(spread, sizes, "bucket", F.col("count"), owners.count() * SETS)
    full = full.withColumn("pieces", F.ceil(F.col("count") / TILE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("bucket", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "node").join(owners, "node")
    dealt = dealt.repartition(shuffle_tasks(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (x == y).sum(axis=-1) >= least
        ok[ok] = np.bitwise_count(np.ascontiguousarray((x ^ y)[ok]).view(np.uint64)).sum(axis=-1) <= limit
        return ok

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, 1 << 14):
            x, node = np.frombuffer(b"".join(f.wide), np.uint8).reshape(-1, octets), f.node.to_numpy()
            fresh = np.concatenate(([True], (np.diff(f.bucket.to_numpy()) != 0) | (np.diff(f.i.to_numpy()) != 0) | (np.diff(f.j.to_numpy()) != 0)))
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(f)))
            group, many = np.repeat(np.arange(len(begin)), size), size > SMALL
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            live = np.flatnonzero(~many[group])
            for gap in range(1, SMALL):  # pairs at that distance in the sorted rows
                live = live[live + gap < len(f)]
                live = live[group[live] == group[live + gap]]
                for part in np.array_split(live, len(live) // (1 << 14) + 1):
                    ok = alike(x[part], x[part + gap])
                    a.append(part[ok])
                    b.append(part[ok] + gap)
            for s, n in zip(begin[many].tolist(), size[many].tolist(), strict=True):
                label = np.arange(s, s + n)
                for row in range(n - 1):
                    rest = np.flatnonzero(label[row + 1 :] != label[row]) + row + 1
                    hit = rest[alike(x[s + rest], x[s + row])]
                    a.append(np.full(len(hit), s + row))
                    b.append(s + hit)
                    label[np.isin(label, label[hit])] = label[row]
                    if (label == label[0]).all():
                        break
            known = _forest(len(f), np.concatenate(a), np.concatenate(b))
            own = np.flatnonzero(known != np.arange(len(f)))
            yield pd.DataFrame({"a": node[own], "b": node[known[own]]}).drop_duplicates()

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def one_of_each(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each group that similar() links: that of the least doc_id, nulls last, then of the least digest of
    the row. Rows are judged by their own text, so those without an id or with a repeated one stay if nothing is near them; texts without words are one group.

    Similarity is that of the sets of shingles of `shingle` words, as 1024 bits estimate it. Texts are shuffled once, to meet the digests of the rows that stay.
    """
    others = [c for c in documents.columns if c != "text"]
    row = F.sha2(F.concat_ws("\n", F.coalesce(F.sha2("text", 256), F.lit("")), F.to_json(F.struct(*others), {"ignoreNullFields": "false"})), 256)
    keyed = documents.select(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", row.alias("digest")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wide_fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["row", "wide"])

    wide = map_arrow(keyed, run, f"row {keyed.schema['row'].dataType.simpleString()}, wide binary")
    owners = checkpoint(wide.groupBy("wide").agg(F.min("row").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    parts = connected_components(similar(owners.select("node", "wide"), similarity))
    named = owners.select("node", "least").join(parts, owners.node == parts.id, "left").select("least", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("least"))
    kept = heads.select(F.col("least.digest").alias("digest")).distinct()
    # equal rows become one before the join, by the same key; all columns go as one, so none can clash
    once = documents.select(F.struct(*documents.columns).alias("own"), row.alias("digest")).groupBy("digest").agg(F.first("own").alias("own"))
    return once.join(kept, "digest", "left_semi").select("own.*")
