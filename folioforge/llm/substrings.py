"""Repeated passages: matching statistics of documents in FM-indexes, one for each shard of passages that may repeat.

A window is `window` consecutive words. The smallest hash among the window's runs of `gram` words is its anchor, so equal
windows have equal anchors wherever they stand. Windows of one anchor that follow each other are one passage, and a
shard holds the passages of some anchors: no occurrence of a window lies outside its shard. Anchors that stand at one place of the
corpus only can't repeat; their passages are left out of the index. Neither step can lose a repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, importable, map_arrow, shuffle_tasks

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Most bits of the broadcast map of repeated anchors (16 MB); when it fills up at a very large scale, more passages are indexed than need be.
MAP_BITS = 1 << 27


NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: An odd number and its inverse modulo 2 ** 64, and as many powers of each as a block has bytes.
BASE = 0x100000001B3
BLOCK = 1 << 21
#: Bytes of distinct passages that a task holds before it passes them on.
HELD = 1 << 25
#: Windows of a passage at most.
LONGEST = 48
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have


def _pieces(text: bytes) -> Iterator[tuple[int, int, bool]]:
    """Bounds of pieces of a text of at most BLOCK bytes that cut no word; a word that is longer is a piece of its own, marked."""
    data, s = np.frombuffer(text, np.uint8), 0
    while s < len(data):
        if SPACE[data[s]]:
            some = np.flatnonzero(~SPACE[data[s : s + BLOCK]])
            s += int(some[0]) if len(some) else BLOCK
            continue
        e = s + BLOCK
        if e >= len(data):
            yield s, len(data), False
            return
        cuts = np.flatnonzero(SPACE[data[s:e]])
        if len(cuts):
            e = s + int(cuts[-1])
            yield s, e, False
        else:
            e = m.start() if (m := NEXT_SPACE.search(text, e)) else len(data)
            yield s, e, True
        s = e


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte bounds of each word of a text, and a hash of its bytes (equal words have equal ones), without a loop over words.

    Sums of byte * BASE ** place up to each place give a word's polynomial by one difference, whatever its length. They are made for BLOCK bytes at a
    time, so a very long text takes little more than its words' hashes.
    """
    none = np.zeros(0, np.int64)
    firsts, lasts, hashes = [none], [none], [np.zeros(0, np.uint64)]
    for s, e, single in _pieces(text):
        if single:
            firsts.append(np.array([s]))
            lasts.append(np.array([e]))
            hashes.append(np.array([xxhash.xxh64_intdigest(memoryview(text)[s:e])], np.uint64))
            continue
        data = np.frombuffer(text, np.uint8)[s:e]
        edge = np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)])))
        h = (sums[last] - sums[first]) * powers(pow(BASE, -1, 1 << 64), len(data))[first]
        firsts.append(first + s)
        lasts.append(last + s)
        hashes.append((h ^ (h >> np.uint64(29))) * MIX)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Numbers of non-empty texts and these joined by a space, in blocks of about BLOCK bytes; a longer text is a block of its own."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if held and size + len(t) > BLOCK:
            yield np.array(held), b" ".join(texts[k] for k in held)
            held, size = [], 0
        held.append(i)
        size += len(t) + 1
    if held:
        yield np.array(held), b" ".join(texts[k] for k in held)


def grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` words of one document."""
    n = len(hashes) - gram + 1
    g = np.zeros(n, np.uint64)
    for k in range(gram):
        g = g * MIX + hashes[k : k + n]
    g ^= g >> np.uint64(31)
    g *= MIX
    return g ^ (g >> np.uint64(29))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of each `width` values in a row, in a logarithm of steps."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(g: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window: the least of its `width` runs."""
    return _slide(g, width, np.minimum)


def anchor_places(g: np.ndarray, anchor: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the runs that are the anchor of a valid window they stand in, each place once: a window that occurs twice has two."""
    none = np.zeros(width - 1, np.uint64)
    return g[_slide(np.concatenate((none, np.where(valid, anchor, np.uint64(0)), none)), width, np.maximum) == g]


def passages(anchor: np.ndarray, valid: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each passage of a block; windows of hot anchors stand alone.

    Text that repeats itself can have one anchor for thousands of windows: a passage ends after LONGEST of them.
    """
    place = np.flatnonzero(valid)
    own = anchor[place]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)))[: len(place)]
    if len(hot):
        new |= np.isin(own, hot)
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate((start, [len(place)])))
    new[(np.arange(len(place)) - np.repeat(start, count)) % LONGEST == 0] = True
    start = np.flatnonzero(new)
    return place[start], np.diff(np.concatenate((start, [len(place)])))


class Windows:
    """The words of a block, of which text each is, and of each window whether it lies in one text, its runs' hashes and its anchor."""

    def __init__(self, numbers: np.ndarray, joined: bytes, texts: list[bytes | None], window: int, gram: int):
        self.first, self.last, h = word_hashes(joined)
        ends = np.cumsum([len(texts[k]) + 1 for k in numbers])
        self.text = np.searchsorted(ends, self.first, side="right")
        self.begin = np.searchsorted(self.text, np.arange(len(numbers)))
        n = len(h) - window + 1
        self.valid = self.text[: max(0, n)] == self.text[window - 1 :] if n > 0 else np.zeros(0, bool)
        self.grams = np.maximum(grams(h, gram), np.uint64(1)) if n > 0 else h
        self.anchors = anchors(self.grams, window - gram + 1) if n > 0 else h


def _texts(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def count_anchors(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, n): the number of places of each anchor, added up in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(0))
            got = [np.zeros(0, np.uint64)]
            for numbers, joined in blocks(texts):
                w = Windows(numbers, joined, texts, window, gram)
                if w.valid.any():
                    got.append(anchor_places(w.grams, w.anchors, w.valid, window - gram + 1))
            a, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return map_arrow(documents.select("text"), count, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


def repeated_spans(documents: DataFrame, window: int = 20, gram: int = 5, words_a_shard: int = 100_000) -> DataFrame:
    """(doc_id, digest, spans): for rows with words to remove, array of (start, end) in words, merged and in order.

    documents: (doc_id, digest, text). A word is removed if a window that covers it has a word sequence that also starts earlier: in a smaller doc_id, or earlier
    in the same document. Words are runs of bytes other than space and \\x09-\\x0D. Null and empty texts have none. Rows that share a
    doc_id with different texts come one after the other, by digest; equal rows are one document. Rows without an id lose nothing.

    Of the occurrences of a passage that a task sees only the earliest goes to the passage's shard: the others repeat it and are told at once.
    A passage that a third of all documents share so gives its shard a row for each task, and not one for each document.
    """
    spark = documents.sparkSession
    importable(spark)
    repeated = checkpoint(count_anchors(documents, window, gram).where("n > 1"))
    number, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << int(min(MAP_BITS.bit_length() - 1, max(16, int(number * 16).bit_length())))
    # Few anchors can be hot: each has over 1/2000 of all passages.
    hot = np.array([r[0] for r in repeated.where(F.col("n") > max(2000, total // 2000)).select("anchor").collect()], np.int64).view(np.uint64)
    words = repeated.select((F.expr(f"pmod(anchor, {bits}L)")).alias("at")).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marks = words.toPandas()
    table = np.zeros(max(1, bits >> 6), np.int64)
    table[marks.word.to_numpy(np.int64)] = marks.bits.to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((table.view(np.uint64), np.sort(hot)))
    shards = max(shuffle_tasks(spark), int(total * 30 // words_a_shard) + 1)

    kind = documents.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = sent.value
        mask = np.uint64(bits - 1)
        where: dict[bytes, list] = {}  # piece: shard, words, earliest occurrence
        told: list[tuple] = []
        held, id_type = 0, None

        def rows(part: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.binary(), id_type, pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], ["shard", "words", "doc_id", "digest", "start", "end"])

        def passed() -> Iterator[pa.RecordBatch]:
            part = []
            for piece, (shard, _, least) in where.items():
                part.append((shard, piece, *least, None))
                if len(part) == 1 << 14:
                    yield rows(part)
                    part = []
            if part:
                yield rows(part)

        for b in batches:
            id_type = b.column(0).type
            docs, digests = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [t if d is not None else None for d, t in zip(docs, _texts(b.column(2)), strict=True)]
            for numbers, joined in blocks(texts):
                w = Windows(numbers, joined, texts, window, gram)
                start, count = passages(w.anchors, w.valid, hot)
                key = w.anchors[start]
                at = key & mask
                ok = (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                start, count, key = start[ok], count[ok], key[ok]
                alone = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                text = w.text[start]
                found = zip(w.first[start].tolist(), w.last[start + count + window - 2].tolist(), key.tolist(), alone.tolist(), numbers[text].tolist(), (start - w.begin[text]).tolist(), (count + window - 1).tolist(), strict=True)
                for s, e, k, x, number, place, n in found:
                    piece, here = joined[s:e], (docs[number], digests[number], place)
                    if (got := where.get(piece)) is None:
                        where[piece] = [(xxhash.xxh64_intdigest(b" ".join(piece.split())) if x else k) % shards, n, here]
                        held += len(piece) + 300
                    elif here != got[2]:
                        late, got[2] = max(here, got[2]), min(here, got[2])
                        told.append((xxhash.xxh64_intdigest(f"{late[0]}:{late[2]}") % shards, None, *late, late[2] + n))
                if len(told) >= 1 << 14:
                    yield rows(told)
                    told = []
            if held > HELD:
                yield from passed()
                where.clear()
                held = 0
        if told:
            yield rows(told)
        yield from passed()

    name = kind.simpleString()
    pieces = map_arrow(documents.select("doc_id", "digest", "text"), cut, f"shard int, words binary, doc_id {name}, digest long, start int, end int")
    found = pieces.groupBy("shard").applyInPandas(lambda f: search_shard(f, window), f"doc_id {name}, digest long, start int, end int")
    return found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def search_shard(f: pd.DataFrame, window: int) -> pd.DataFrame:
    """Removed spans (doc_id, digest, start, end) of each passage's occurrences, by matching statistics of the passages in the index of the distinct ones.

    Each passage is read from its end. A backward step puts one word before the current match; then the match is cut to `window`
    words again by widening its rows to all suffixes that begin with the same `window` words. Those rows are the window's
    occurrences, and the least (document, place) among them is where it starts first.
    """
    from .fmindex import FMIndex

    told = f[f.words.isna()]
    done = told[["doc_id", "digest", "start", "end"]]
    f = f[f.words.notna()]
    if not len(f):
        return done
    first: dict[bytes, int] = {}
    passage = np.array([first.setdefault(w, len(first)) for w in f.words], np.int64)
    # Documents as numbers, in the order of (doc_id, digest).
    ids, by_id = np.unique(f.doc_id.to_numpy(), return_inverse=True)
    digests, by_digest = np.unique(f.digest.to_numpy(), return_inverse=True)
    both, docs = np.unique(by_id * len(digests) + by_digest, return_inverse=True)
    starts = f.start.to_numpy().astype(np.int64)
    split = [w.split() for w in first]
    sizes = np.array([len(w) for w in split], np.int64)
    numbers = {x: k + 2 for k, x in enumerate(set(chain.from_iterable(split)))}
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    del split, numbers
    # One separator, 1, ends each passage; no window holds it.
    symbols = np.ones(int(sizes.sum() + len(sizes)), np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    # window as a sum of powers of two: two suffixes agree that far if their ranks at those widths agree one after another.
    widths = [1 << k for k in reversed(range(window.bit_length())) if window >> k & 1]
    ranks: dict[int, np.ndarray] = dict.fromkeys(widths)
    index = FMIndex(symbols, depth=window + 1, ranks=ranks)
    # The earliest occurrence of each passage; and of each place in the index that begins a window.
    by = np.lexsort((starts, docs, passage))
    heads = np.concatenate(([True], np.diff(passage[by]) != 0))
    least_doc, least_start = docs[by][heads], starts[by][heads]
    where = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(symbols)) - begin[where]
    valid = inside <= sizes[where] - window
    # Rows whose suffixes begin with the same `window` words lie together: where each such run begins and ends.
    n, order = index.n, index.order
    same, a, b = np.ones(n - 1, bool), order[:-1], order[1:]
    for width in widths:
        same &= ranks[width][np.minimum(a, n - 1)] == ranks[width][np.minimum(b, n - 1)] if ranks[width] is not None else a == b
        a, b = a + width, b + width
    del ranks
    run_first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(n), 0))
    ends = np.where(np.concatenate((~same, [True])), np.arange(n), n)
    run_last = np.minimum.accumulate(ends[::-1])[::-1]
    # (document, place) as one number, and the least of the occurrences in each run.
    spot = np.full(n, np.iinfo(np.int64).max)
    spot[:-1] = np.where(valid, (least_doc[where] << 32) + least_start[where] + inside, spot[:-1])
    least = np.minimum.reduceat(spot[order], np.flatnonzero(np.concatenate(([True], ~same))))
    run = np.cumsum(np.concatenate(([True], ~same))) - 1
    # Matching statistics, all passages side by side, from their ends to their beginnings.
    early = spot[:-1].copy()
    down = np.argsort(-sizes, kind="stable")
    last, lo, hi = (begin + sizes - 1)[down], np.zeros(len(sizes), np.int64), np.full(len(sizes), n, np.int64)
    for back in range(int(sizes.max())):
        live = int(np.searchsorted(-sizes[down], -back, side="left"))
        place = last[:live] - back
        c = symbols[place]
        lo, hi = np.split(index.step(np.tile(c, 2), np.concatenate((lo[:live], hi[:live]))), 2)
        if back >= window - 1:
            lo, hi = run_first[lo], run_last[hi - 1] + 1
            early[place] = least[run[lo]]
    # Windows of each passage that start earlier elsewhere; later occurrences of a passage repeat it as a whole.
    late = valid & (early < spot[:-1])
    edge = np.diff(np.concatenate(([0], late.view(np.int8), [0])))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = where[s] if len(s) else np.zeros(0, np.int64)
    repeat = by[~heads]
    repeat = repeat[(docs[repeat] != least_doc[passage[repeat]]) | (starts[repeat] != least_start[passage[repeat]])]
    late_docs = both[np.concatenate([least_doc[p], docs[repeat]])]
    out = pd.DataFrame(
        {
            "doc_id": ids[late_docs // len(digests)],
            "digest": digests[late_docs % len(digests)],
            "start": np.concatenate([least_start[p] + s - begin[p], starts[repeat]]).astype(np.int32),
            "end": np.concatenate([least_start[p] + e - begin[p] + window - 1, starts[repeat] + sizes[passage[repeat]]]).astype(np.int32),
        }
    )
    return pd.concat([out, done], ignore_index=True) if len(done) else out


def remove(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256): text is the kept words joined by one space. One row for each row, as repeated_spans() judges it."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    spans = checkpoint(repeated_spans(rows, window))
    none = F.lit(None).cast("array<int>")
    told = rows.where("doc_id is not null").join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    joined = told.unionByName(rows.where("doc_id is null").select("doc_id", "text", none.alias("starts"), none.alias("ends")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone, digests = [], [], [], []
            for t, starts, ends in zip(_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = t.split() if t else []
                kept = words
                if starts:
                    kept, at = [], 0
                    for s, e in zip(starts, ends, strict=True):
                        kept += words[at:s] if s > at else []
                        at = max(at, e)
                    kept += words[at:]
                texts.append(b" ".join(kept))
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(texts[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(joined, apply, f"doc_id {kind}, text string, n_words long, n_removed long, kept_sha256 string")
