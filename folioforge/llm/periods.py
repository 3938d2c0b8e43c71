"""Periodic runs of words: a text's words are recompressed into a run-length grammar, whose levels answer how far two places agree.

Recompression alternates two rounds. A block round gives each stretch of one symbol a name for (symbol, length); a pair round sides the symbols by a hash and gives each
neighbouring left-right pair a name. Equal stretches are cut alike at every level but for their edges, so two places agree as far as a walk up and down
the levels finds (an LCE query), with a few steps a level. No suffix array is built. The candidates are a harmonic grid: a run of period q and four periods or more holds
four multiples of q in a row, so only places k * q whose next three hold the same word are asked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Words of the texts that share a grammar; a longer text has its own.
TOGETHER = 200_000
#: LCE queries that are answered at once, and grid places that are tried at once.
QUERIES, GRID = 1 << 18, 1 << 20
#: Symbols that are too few to compress further.
FEW = 16


class Grammar:
    """The levels of a sequence of symbols in which no two occurrences of a separator are alike, first and last places being separators.

    Level l has its symbols, and to the next level: down, the place where each of the next level's symbols begins here (and the end), and of, the next level's symbol that
    each symbol here is part of.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[np.ndarray] = [symbols.astype(np.int64)]
        self.down: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.blocks: list[bool] = []
        self.next = int(symbols.max()) + 1
        salt = 0
        while len(self.levels[-1]) > FEW and salt < 400:
            self._block_round()
            for _ in range(8):
                salt += 1
                if self._pair_round(salt):
                    break

    def _put(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        n = len(self.levels[-1])
        of = np.zeros(n, np.int64)
        of[starts[1:]] = 1
        self.of.append(np.cumsum(of))
        self.down.append(np.append(starts, n))
        self.levels.append(symbols)
        self.blocks.append(blocks)

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New symbols for keys, equal ones alike."""
        _, name = np.unique(keys, return_inverse=True)
        out = self.next + name
        self.next += int(name.max()) + 1
        return out

    def _block_round(self) -> None:
        x = self.levels[-1]
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        if len(starts) == len(x):
            return
        length, y = np.diff(np.append(starts, len(x))), x[starts].copy()
        many = length > 1
        y[many] = self._named(y[many] * (int(length.max()) + 1) + length[many])
        self._put(starts, y, True)

    def _pair_round(self, salt: int) -> bool:
        """False if the sides that the hash gives bring few pairs together."""
        x = self.levels[-1]
        mixed = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD1B54A32D192ED03 % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left = (mixed >> np.uint64(63)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:])
        if len(pair) < max(1, len(x) // 6):
            return False
        second = np.zeros(len(x), bool)
        second[pair + 1] = True
        starts = np.flatnonzero(~second)
        y = x.copy()
        y[pair] = self._named(x[pair] * self.next + x[pair + 1])
        self._put(starts, y[starts], False)
        return True

    def _same(self, level: int, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        x = self.levels[level]
        return x[i] == x[j] if step > 0 else x[i - 1] == x[j - 1]

    def _passed(self, level: int, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols to pass at once where both have the same one next: one, or what is left of both blocks."""
        if level == len(self.blocks) or not self.blocks[level]:
            return np.ones(len(i), np.int64)
        of, down = self.of[level], self.down[level]
        if step > 0:
            return np.minimum(down[of[i] + 1] - i, down[of[j] + 1] - j)
        return np.minimum(i - down[of[i - 1]], j - down[of[j - 1]])

    def _border(self, level: int, i: np.ndarray) -> np.ndarray:
        """Whether a symbol of the next level begins at a place."""
        return self.down[level][self.of[level][i]] == i

    def agree(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """For pairs of places how many symbols agree from i and j on (step 1), or right before them (step -1). The places of a pair differ."""
        i, j, begun = i.astype(np.int64), j.astype(np.int64), i.astype(np.int64).copy()
        turned = np.zeros(len(i), np.int64)  # the level at which a pair first disagrees
        up, last = np.arange(len(i)), len(self.down)
        for level in range(last + 1):
            moving = up
            while len(moving):  # to a border of the next level in both, or to where they differ
                if level < last:
                    moving = moving[~(self._border(level, i[moving]) & self._border(level, j[moving]))]
                same = self._same(level, i[moving], j[moving], step)
                turned[moving[~same]] = -1 - level
                moving = moving[same]
                by = self._passed(level, i[moving], j[moving], step) * step
                i[moving] += by
                j[moving] += by
            up = up[turned[up] == 0]
            if level < last:
                i[up], j[up] = self.of[level][i[up]], self.of[level][j[up]]
        turned = -1 - turned
        for level in range(last - 1, -1, -1):
            here = np.flatnonzero(turned > level)
            i[here], j[here] = self.down[level][i[here]], self.down[level][j[here]]
            moving = here
            while len(moving := moving[self._same(level, i[moving], j[moving], step)]):
                by = self._passed(level, i[moving], j[moving], step) * step
                i[moving] += by
                j[moving] += by
        return (i - begun) * step


def _tried(x: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for periods low..high-1: places k * period of x that the same word holds as the next three multiples."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if high - low <= 8:
        for q in range(low, high):
            y = x[::q]
            same = y[1:] == y[:-1]
            at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
            found.append((at, np.full(len(at), q)))
    else:
        q = np.arange(low, high)
        number = (len(x) - 1) // q - 2
        ends = np.cumsum(number)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], GRID), "right")
        for a, b in zip(cuts, [*cuts[1:], len(q)], strict=True):
            if a < b:
                n = number[a:b]
                each = np.repeat(q[a:b], n)
                at = (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)) * each
                ok = np.flatnonzero(x[at] == x[at + each])
                at, each = at[ok], each[ok]
                ok = (x[at] == x[at + 2 * each]) & (x[at] == x[at + 3 * each])
                found.append((at[ok], each[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(texts: list[np.ndarray], least: int = 6, periods: int = 4) -> list[np.ndarray]:
    """For each sequence of word numbers its runs (start, length, period) by start, then period: stretches of smallest period q, at least max(least, periods * q) long,
    that no neighbour extends. periods is 4 or more.

    The periods are tried in octaves. A candidate whose four places lie inside a run of a smaller period adds none: its own run would be that one.
    """
    grammar, out = None, []
    first = np.cumsum([1, *[len(x) + 1 for x in texts]])
    for x, start in zip(texts, first, strict=False):
        found = np.zeros((0, 3), np.int64)
        low = 1
        while periods * low <= len(x):
            high = min(2 * low, len(x) // periods + 1)
            at, q = _tried(x, low, high)
            if len(found) and len(at):
                by = found[np.argsort(found[:, 0], kind="stable")]
                reach = np.append(0, np.maximum.accumulate(by[:, 0] + by[:, 1]))
                ok = reach[np.searchsorted(by[:, 0], at, "right")] <= at + 3 * q
                at, q = at[ok], q[ok]
            if len(at) and grammar is None:
                grammar = Grammar(_joined(texts))
            for k in range(0, len(at), QUERIES):
                i, p = at[k : k + QUERIES] + start, q[k : k + QUERIES]
                back, ahead = grammar.agree(i, i + p, -1), grammar.agree(i, i + p)
                length = back + ahead + p
                ok = length >= np.maximum(least, periods * p)
                found = np.unique(np.concatenate((found, np.stack(((i - back - start)[ok], length[ok], p[ok]), axis=1))), axis=0)
            low = high
        # of equal stretches the smallest period
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        if len(found):
            found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
        out.append(found[np.lexsort((found[:, 2], found[:, 0]))])
    return out


def _joined(texts: list[np.ndarray]) -> np.ndarray:
    """The sequences one after the other, separators around each."""
    most = max(int(x.max()) for x in texts if len(x)) + 1
    parts = [np.array([most])]
    for k, x in enumerate(texts):
        parts += [x, np.array([most + 1 + k])]
    return np.concatenate(parts)


def numbered(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and each as the number of its first like."""
    words = (text or b"").split()
    known: dict[bytes, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the words of a document are taken from if its text is to be made periodic: one in ten by the CRC-32 of its id is, from some word on. None: left as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i, p = np.arange(n), 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def greatest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period, then smallest start, then period."""
    best = None
    for s, n, p in found.tolist():
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Words that a run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.cumsum(marks)[:n] > 0


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find(documents: DataFrame, plant: bool = False, least: int = 6, periods: int = 4, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row for each row of documents; keep_text adds text, the kept words joined by one space.

    start, length, period and exponent_milli are those of the greatest run, null without one. Null and empty texts have no words; repeated and null ids are
    judged each by their own text. plant makes one text in ten periodic before it is searched, as planted() says (never for a null id); other columns are left out.
    An empty table gives none. Texts are read where they lie, nothing is shuffled.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def told(group: list) -> list[tuple]:
        rows = []
        for (i, words, x), found in zip(group, runs([g[2] for g in group], least, periods), strict=True):
            best, kept = greatest(found), np.flatnonzero(~dropped(found, len(x))).tolist()
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
            text = b" ".join([words[k] for k in kept])
            rows.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), *([text.decode(errors="replace")] if keep_text else [])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")], *["text"] * keep_text]
            types = [b.schema.field(0).type, *[pa.int64()] * 5, *[pa.string()] * (2 + keep_text)]
            out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            group, held = [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words, x = numbered(text.as_py())
                if plant and (source := planted(i, len(x))) is not None:
                    words, x = [words[k] for k in source.tolist()], x[source]
                if group and held + len(x) > TOGETHER:
                    yield out(told(group))
                    group, held = [], 0
                group.append((i, words, x))
                held += len(x)
            if group:
                yield out(told(group))

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, {COLUMNS}" + ", text string" * keep_text)
