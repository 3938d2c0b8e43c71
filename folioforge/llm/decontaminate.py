"""Benchmark decontamination with an FM-index for each shard of training documents.

Words that no test phrase holds can't take part in an occurrence, so a shard's index is built over the runs
of test words that are long enough for the shortest phrase; one separator stands for all between two runs.
This reduction of the alphabet is exact, and keeps a shard's index small beside its documents. All phrases
are searched backwards in the index at once through wavelet matrix ranks; occurrences are located by
sampled suffix positions and merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

WINDOW = 13
#: Lower-cases A-Z and turns every byte that no word holds into a space; bytes from 0x80 on belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Phrases:
    """The windows of some items: the items' words as numbers of their own vocabulary (1 up; 0 is any other word), and by length where each window begins
    and whose it is. About three bytes a byte of text, and the vocabulary."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        own, where, at = [np.zeros(0, np.int32)], {}, 0
        for k, (_, text) in enumerate(items):
            w = words(text)
            if not w:
                continue
            own.append(np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w), np.int32, len(w)))
            size = min(window, len(w))
            where.setdefault(size, []).append((at, len(w) - size + 1, k))
            at += len(w)
        self.words = np.concatenate(own)
        self.lengths = sorted(where)
        self.starts = {m: np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, n, _ in x]) for m, x in where.items()}
        self.items = {m: np.concatenate([np.full(n, k, np.int32) for _, n, k in x]) for m, x in where.items()}

    def patterns(self, m: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The windows of m words in blocks: a row of words each, and their items."""
        for s in range(0, len(self.starts[m]), block):
            yield self.words[self.starts[m][s : s + block, None] + np.arange(m)], self.items[m][s : s + block]


def search_shard(p: Phrases, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text of a shard: its number of words, the merged spans of words inside occurrences, the ids of items that occur."""
    from .fmindex import FMIndex

    get, zero = p.vocabulary.get, 0
    sizes = np.zeros(len(texts), np.int64)
    chunks, owners, places = [], [], []
    shortest = p.lengths[0] if p.lengths else 0
    for d, text in enumerate(texts):
        own = words(text)
        sizes[d] = len(own)
        if not own or not shortest:
            continue
        ids = np.array([get(w, zero) for w in own], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= shortest:
                chunks += [ids[a:b], np.zeros(1, np.int64)]
                owners.append(np.full(b - a + 1, d))
                places.append(np.arange(a, b + 1))
    spans, found = [[] for _ in texts], [set() for _ in texts]
    if not chunks:
        return sizes, spans, found
    symbols = np.concatenate(chunks)
    symbols[symbols == 0] = len(p.vocabulary) + 1
    dense, symbols = np.unique(symbols, return_inverse=True)
    owner, place = np.concatenate(owners), np.concatenate(places)
    index = FMIndex(symbols + 1, sample=8)
    covered = np.zeros(len(symbols) + 1, np.int64)
    for m, (patterns, whose) in ((m, block) for m in p.lengths for block in p.patterns(m)):
        at = np.searchsorted(dense, patterns)
        known = (at < len(dense)) & (dense[np.minimum(at, len(dense) - 1)] == patterns)
        lo, hi = index.search(np.where(known, at + 1, 0))
        hits = np.flatnonzero(hi > lo)
        count = (hi - lo)[hits]
        if not len(hits):
            continue
        rows = np.repeat(lo[hits] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start, which = index.locate(rows), np.repeat(hits, count)
        np.add.at(covered, start, 1)
        np.add.at(covered, start + m, -1)
        for d, k in np.unique(np.stack([owner[start], whose[which]], axis=1), axis=0).tolist():
            if p.ids[k] is not None:
                found[d].add(p.ids[k])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered) > 0).view(np.int8)))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        spans[owner[a]].append((int(place[a]), int(place[b - 1]) + 1))
    return sizes, spans, found


def _parts(items: DataFrame, part_bytes: int, item_id: str) -> list:
    """The items' windows in parts of about part_bytes of text, each built and sent by itself: neither the driver nor a worker holds more than one."""
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = int(size // part_bytes) + 1
    out = []
    for k in range(number):
        of = F.pmod(F.xxhash64(item_id, "text"), F.lit(number)) == k
        rows = items.where(of).select(item_id, F.col("text").cast("binary")).collect()
        out.append(spark.sparkContext.broadcast(Phrases([(r[0], bytes(r[1]) if r[1] is not None else None) for r in rows])))
    return out


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def search_parts(parts: list, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """search_shard() for all parts of the items, one after the other."""
    sizes, spans, found = None, [[] for _ in texts], [set() for _ in texts]
    for part in parts:
        sizes, s, f = search_shard(part.value, texts)
        if len(parts) == 1:
            return sizes, s, f
        for d in range(len(texts)):
            spans[d] += s[d]
            found[d] |= f[d]
        part.__dict__.pop("_value", None)  # read anew for the next shard, so that a worker holds one part at a time
    return sizes, [_united(x) for x in spans], found


def contamination(documents: DataFrame, items: DataFrame, part_bytes: int = 1 << 23, shard_bytes: int = 1 << 25, item_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): words of each document, those inside occurrences of a test window, merged spans of these
    as (start, end) in words, and the ids of items with occurring windows, sorted as strings.

    A shard is what one task reads, in pieces of about shard_bytes of text. The items are searched in parts of part_bytes, whatever their
    size. Null and empty texts have no words. One row for each row, judged by its own text, null and repeated doc_ids included. An id that
    several items share is listed once; items without an id mark words and are not listed.
    """
    parts = _parts(items, part_bytes, item_id)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def out():
            sizes, spans, found = search_parts(parts, held)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(sizes), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "spans", "items"],
            )

        for b in batches:
            ids.append(b.column(0))
            held += b.column(1).cast(pa.binary()).to_pylist()
            size += b.column(1).nbytes
            if size >= shard_bytes:
                yield out()
                held, ids, size = [], [], 0
        if ids:
            yield out()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), search, f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(documents: DataFrame, items: DataFrame, part_bytes: int = 1 << 23, shard_bytes: int = 1 << 25, item_id: str = "item_id") -> DataFrame:
    """The documents that are not contaminated(), judged as contamination() does; each row by itself, so null and repeated ids stay and
    nothing is shuffled."""
    parts = _parts(items, part_bytes, item_id)
    place = documents.columns.index("text")

    def kept(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, spans, _ = search_parts(parts, [t for b in held for t in b.column(place).cast(pa.binary()).to_pylist()])
        hit, at = np.array([sum(b - a for a, b in x) for x in spans], np.int64), 0
        stays = (hit == 0) | (20 * hit < sizes)
        for b in held:
            yield b.filter(pa.array(stays[at : at + len(b)]))
            at += len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(place).nbytes
            if size >= shard_bytes:
                yield from kept(held)
                held, size = [], 0
        if held:
            yield from kept(held)

    return map_arrow(documents, run, documents.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of contamination()."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
