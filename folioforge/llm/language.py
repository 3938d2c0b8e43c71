"""Language by prediction by partial matching: a byte context tree for each language, exact code lengths under frozen counts."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, map_arrow

ORDER = 3
UNIT = 1024  # code lengths are whole numbers of 1/UNIT bit, so that their sums are exact in any order


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@dataclass
class Tree:
    """One language's tree over its own alphabet. symbols: 256 bytes to symbols (0: outside a text, 1: a byte that training lacks). The deepest node of the
    context (a, b, c) is deep[pair[a * size + b] * size + c], bits the code length of (node, symbol)."""

    symbols: np.ndarray
    pair: np.ndarray
    deep: np.ndarray
    bits: np.ndarray
    size: int


@dataclass
class Model:
    """languages by code point; trees packed, and unpacked where they are used first."""

    languages: list[str]
    packed: list[bytes]

    def trees(self) -> list[Tree]:
        if "_trees" not in self.__dict__:
            self.__dict__["_trees"] = [Tree(*pickle.loads(zlib.decompress(p))) for p in self.packed]
        return self.__dict__["_trees"]

    def __getstate__(self):
        return {"languages": self.languages, "packed": self.packed}


def _grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with the three before it as a 32-bit number; zero bytes stand before a text."""
    data = np.frombuffer(b"".join(b"\0\0\0" + t.replace(b"\0", b" ") for t in texts), np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    return grams[data[3:] != 0]


def train(documents: DataFrame, docs_per_language: int = 1200, least: int = 4) -> Model:
    """Counts of bytes after contexts of up to three bytes, from text and lang of a sample of non-null rows.

    The sample takes each document by a hash, about docs_per_language of a language (all, if it has fewer): a bound on what a language's
    tree is made of, whatever the input. Whole texts are used. Contexts seen fewer than `least` times have no node. Each language's tree is built in
    a task of its own; the driver only passes the packed trees on, so any number of languages is learned.
    """
    importable(documents.sparkSession)
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = labelled.groupBy("lang").agg((F.lit(float(docs_per_language)) / F.count("*")).alias("share"))
    u = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                grams, n = np.unique(_grams([t for t, x in zip(texts, langs, strict=True) if x == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def grow(f: pd.DataFrame) -> pd.DataFrame:
        t = build(f.gram.to_numpy(np.int64), f.n.to_numpy(np.float64), least)
        return pd.DataFrame({"lang": f.lang.iloc[:1], "tree": [zlib.compress(pickle.dumps((t.symbols, t.pair, t.deep, t.bits, t.size)), 6)]})

    # One row for each language: the table is smaller than the model, which goes to all tasks.
    drawn = labelled.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")
    counted = map_arrow(drawn, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInPandas(grow, "lang string, tree binary").collect()
    rows.sort(key=lambda r: r[0].encode())
    return Model([r[0] for r in rows], [bytes(r[1]) for r in rows])


def build(grams: np.ndarray, n: np.ndarray, least: int = 4) -> Tree:
    """The tree of all contexts seen `least` times, and the code length of every symbol at every node (escape method C with exclusion; what no context
    holds is one of the bytes that training lacks, all equally likely)."""
    parts = np.stack([(grams >> s) & 255 for s in (24, 16, 8, 0)], axis=1)
    used = np.unique(parts[:, 3])
    symbols = np.ones(256, np.int64)
    symbols[0] = 0
    symbols[used] = np.arange(2, 2 + len(used))
    size = 2 + len(used)
    parts = symbols[parts]
    # Below all contexts: the used bytes and the 256 - len(used) others are equally likely. Bytes of 0 are spaces (_grams()).
    below = np.full((1, size), 1 / 256)
    below[0, 0] = 0
    prob, nodes = None, [np.zeros(0, np.int64)] * (ORDER + 1)
    deep = np.zeros((1,), np.int64)  # node of each context of the order below
    rows = []
    for order in range(ORDER + 1):
        context = np.zeros(len(grams), np.int64)
        for k in range(3 - order, 3):
            context = context * size + parts[:, k]
        seen, where = np.unique(context, return_inverse=True)
        kept = np.bincount(where, n) >= least if order else np.ones(len(seen), bool)
        place = np.cumsum(kept) - 1
        own = kept[where]
        seen = seen[kept]
        table = np.zeros((len(seen), size))
        np.add.at(table, (place[where][own], parts[own, 3]), n[own])
        if order:
            shorter = seen % size ** (order - 1)
            below = prob[deep[shorter]] if order < ORDER else prob[node2[shorter]]
        hit = table > 0
        amount, kinds = table.sum(axis=1, keepdims=True), hit.sum(axis=1, keepdims=True)
        left = np.maximum(1 - (below * hit).sum(axis=1, keepdims=True), 1e-9)
        here = np.where(hit, table / np.maximum(amount + kinds, 1), kinds / np.maximum(amount + kinds, 1) * below / left)
        first = 0 if prob is None else len(prob)
        prob = here if prob is None else np.concatenate([prob, here])
        nodes[order] = seen
        if order and order < ORDER:
            longer = np.arange(size**order)
            deep = deep[longer % size ** (order - 1)]
            deep[seen] = first + np.arange(len(seen))
            node2 = deep
        elif order == ORDER:
            pairs, at = np.unique(seen // size, return_inverse=True)
            pair = np.tile(np.arange(size), size)
            pair[pairs] = size + np.arange(len(pairs))
            rows = node2.reshape(size, size)[np.concatenate([np.arange(size), pairs % size])]
            rows[size + at, seen % size] = first + np.arange(len(seen))
    bits = np.rint(-np.log2(np.maximum(prob, 1e-12)) * UNIT).astype(np.uint16)
    bits[:, 0] = 0
    return Tree(symbols.astype(np.int32), pair.astype(np.int32), rows.astype(np.int32).ravel(), bits.ravel(), size)


def code_lengths(model: Model, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """(texts, languages): the code length of each whole text, in 1/UNIT bit."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and (held == 0 or held + len(texts[stop]) < block):
            held += len(texts[stop])
            stop += 1
        data = np.frombuffer(b"".join(b"\0\0\0" + t.replace(b"\0", b" ") for t in texts[start:stop]), np.uint8)
        ends = np.cumsum([len(t) + 3 for t in texts[start:stop]])
        for lo in range(3, len(data), block):  # a very long text goes in pieces
            hi = min(len(data), lo + block)
            edges = np.concatenate(([0], np.clip(ends, lo, hi) - lo))
            for k, t in enumerate(model.trees()):
                x = t.symbols[data[lo - 3 : hi]]
                row = t.pair[x[:-3] * t.size + x[1:-2]]
                cost = t.bits[t.deep[row * t.size + x[2:-1]] * t.size + x[3:]]
                sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(cost, dtype=np.int64)))
                out[start:stop, k] += sums[edges[1:]] - sums[edges[:-1]]
        start = stop
    return out


def _told(m: Model, texts: list[bytes | None], lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; und and 0 for those without a letter, or for all if nothing was learned."""
    names = np.array([*m.languages, "und"], dtype=object)
    if not m.languages:
        return names[np.zeros(len(texts), int)], np.zeros(len(texts))
    bits = code_lengths(m, [t if t is not None and k else b"" for t, k in zip(texts, lettered, strict=True)])
    p = 1 / np.exp2(np.clip((bits.min(axis=1, keepdims=True) - bits) / UNIT, -1000, 0)).sum(axis=1)
    return names[np.where(lettered, bits.argmin(axis=1), len(m.languages))], np.where(lettered, p, 0.0)


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of the shortest code, and its share of the likelihood over all languages.

    und and score 0 where the text is null or has no letter, or nothing was learned. Ties go to the language first by code point.
    One row for each row; other columns are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, p = _told(shared.value, b.column(2).cast(pa.binary()).to_pylist(), np.array(b.column(3).to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(p, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "text", _has_letter())
    return map_arrow(rows, score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with lang as predict() gives it (und: none); each row by itself, so null and repeated ids stay and nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    text, lang = documents.columns.index("text"), documents.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *columns, lettered = b.columns
            names, _ = _told(shared.value, columns[text].cast(pa.binary()).to_pylist(), np.array(lettered.to_pylist(), bool))
            columns[lang] = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return map_arrow(documents.select("*", _has_letter()), run, documents.schema)
