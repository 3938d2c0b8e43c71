"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained here from a small labelled table and decoded by Viterbi over batches of word windows in numpy.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The patterns of the base kinds. A run of digits can only match from its first one, hence the lookbehinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
KINDS = ("email", "ip", "card", "phone", "name", "number")

#: Labelled sentences: [name ...] and [number ...] hold what is personal.
LABELLED = """
please call [number 555-0142] after noon
tel. [number 0171-2334455] or write
phone: [number 555-867-5309] thank you
phone [number (030) 1234567] is ours
Phone: [number (415) 555-0132] or mail
tel [number (0221) 998877] until five
mobile [number 07700-900123] is best
mobile: [number 07700 900456] in the evening
cell [number 917-555-0110] works
call me at [number 202-555-0173] today
call [number 020 7946 0958] now
fax: [number 030-1234567] works too
fax [number 5550199] is off
phone [number 415-555-0198] anytime.
my telephone is [number 5551234] at home
his ssn is [number 123-45-6789] on file
SSN: [number 987-65-4321] was given
My SSN is [number 457-55-5462].
social security number [number 078-05-1120] appears
my ssn [number 219-09-9999] is private.
passport no. [number X1234567] was issued
passport number [number C01X00T47] expires
her passport is [number 512345678] and valid
iban [number DE89370400440532013000] was used
iban: [number FR7630006000011234567890189] please
account iban [number ES9121000418450200051332] closed
born on [number 1984-03-12] in spring
she was born [number 12/05/1990] at noon
dob: [number 02/11/1979] is noted
DOB [number 1975-06-21] on the form
date of birth [number 1990-07-30] given
date of birth: [number 03.04.1988] as told
dear mr. [name Smith] we thank you
Mr. [name John Miller] will come
Mrs. [name Anna Berger] has left
Miss [name Emily Stone] plays well
Dr. [name Chen] sees patients
Prof. [name Maria Keller] teaches law
Ms. [name Laura Jones] said so
then Mr. [name Brown] went home
we asked Mrs. [name Helen Ward] about it
my name is [name Peter Brown] and I live here
my name is [name Sofia] and
name: [name Maria Lopez] is listed
Name: [name David Cole]
a man named [name Victor Hugo] wrote
contact Mr. [name Hans Weber] for that
contact [name Julia Stern] for tickets
please contact [name Paul Adams] by mail
Sincerely, [name Robert Downing]
sincerely [name Alice Moore]
Kind regards, [name Thomas Reed]
best regards [name Nina Patel]
signed by [name Clara Weiss] on Monday
signed: [name Oliver Grant]
author: [name Jane Austen]
herr [name Karl Schmidt] kommt morgen
Herr [name Schneider] ist da
frau [name Eva Klein] ist hier
Sehr geehrte Frau [name Vogel] wir danken
mme. [name Claire Dubois] est ici
Monsieur [name Jean Petit] arrive
señor [name Carlos Ruiz] vive cerca
señora [name Elena Torres] trabaja
Then Dr. [name Lewis] came with Mrs. [name Clark] and left
Mr. [name Jones] and Mrs. [name Taylor] and Dr. [name White] met
telephone: [number 555-0155], or write
telephone [number 555-0123] of the shop
ask my ssn [number 222-33-4444] and go
the ssn [number 333-22-1111] of the man
Social security number: [number 444-55-6666]
my social security is [number 123-12-1234]
Passport number: [number M1234567] of France
passport [number L7654321] was lost
IBAN: [number NL91ABNA0417164300] at the bank
IBAN [number GB33BUKB20201555555555] in London
he was born on [number 1961-08-04] in Berlin
born [number 1972-02-29] in Rome
my name is [name Maria] and I sing
My name is [name Daniel] and this is
your name is [name Susan] then
signed by [name John Carter]
signed [name Peter Lang]
was signed by [name Eva Stein] there
Herr [name Becker] wohnt in Köln
Herr [name Otto Braun] wohnt in Mainz
Frau [name Lange] kommt aus Bonn
her mobile is [number 0171 1234567] since then
his cell is [number 0160 9876543] now
the fax is [number 030-7654321] there
fax [number 040-1234567] or phone [number 040-7654321] here
the name of the thing was lost
the number of people grew. It was 1200
number 15 of 20 is here
no 2021-03-04 report was found
the phone number was 12 digits long
signed by hand. The paper is old
we saw the sea. Then. Later
thanks for the tea. Goodbye. Maria
and so it ended. Fine. The End
he left at noon. Nothing. Silence
the long way home. Autumn Leaves
published under the Apache License
made by the Free Software Foundation
he was born on [number 1948-03-09] in Leeds
she was born on [number 2001-12-24] in Graz
call the other one and wait
call it a day
he was born in the old house
she was born in Paris in 1920 and died
the phone was on the table
the telephone rang twice
The Old House stands. It is here
version 1.2.3 of 2024 has 15 pages
Version 10.4 was released. It is faster
page 12 of 340 shows it
in 1984 there were 1,200 people
see section 4.2 and table 7
it cost 12.50 and then 13
The meeting of 2021-05-04 was long
on 2020-01-15 and 2020-02-20 we met
chapter 3 verse 16
items 100-200 are in stock
order 4711 shipped on monday
invoice 2023-0042 was paid
isbn 978-3-16-148410-0 is the book
room 12-34 is free
at 10:30 we begin
open 9-17 on weekdays
mr and mrs left
account number is missing
the name is unknown
name of the rose
a social event in a security zone
contact us for more. We are open
contact the office. They will help
no regards were sent
the author of the book is unknown. It sold well
the letter was signed. Nobody came
Licensed under the MIT License.
Copyright 2019 The Example Authors. All rights reserved
We went to London. The River was high, and Tower Bridge opened
In New York City. Many People live
Words Like These. Are Only Titles. In Text
Monday. Tuesday. Then came the Weekend
The Spring, Summer and Autumn. Winter was cold
La Casa Grande. El Perro, de la noche
der Weg. Die Straße, und ein Haus. Der Tag war lang
Das Haus am See. Berlin ist groß, aber Hamburg auch
dans le pays. Été comme hiver, les gens. Paris est
el camino. Año nuevo, vida nueva. España es bonita
item | price | total | 12.50
a b. c d, e f
it is 3.5 or -4 or 1/2
on 15 may or 20 june it was 30
serial 123-456-789 of the device
from 1990-1995 the price rose 12 percent
the score was 3-2 and 100-98
the code is 12345 67890 and done
""".strip().split("\n")

#: Words whose own form tells, whatever their case.
CUES = frozenset(
    "phone tel telephone mobile cell call fax ssn social security passport iban dob born birth mr mrs ms miss dr prof herr frau mme monsieur madame señor señora "
    "name named number no sincerely regards contact signed author isbn page pages version section chapter room item items order invoice serial code".split()
)
TAGS = ("O", "B-name", "I-name", "B-number", "I-number")
EDGE = 1
STRIP = ".,;:!?()[]\"'"


def shape(word: str) -> str:
    """X, x and d for upper case, lower case and digits; runs are one sign, of digits with their length up to 5."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    signs = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"d+", lambda m: f"d{min(5, len(m[0]))}", re.sub(r"([Xx])\1*", r"\1", signs))


def feature(word: str) -> tuple[str, str]:
    """(shape, "") of a word, or ("", cue)."""
    inner = word.strip(STRIP)
    cue = inner.lower()
    return ("", cue) if cue in CUES else (shape(inner), "")


@dataclass
class Field:
    """known: feature() to number; 0 is any other, EDGE what lies outside a text. weights: scores by place (before, own, after), feature, tag. moves: tag to tag. first: of the first tag."""

    known: dict[tuple[str, str], int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED:
        words, tags = [], []
        for part in re.findall(r"\[\w+ [^\]]+\]|\S+", line):
            if m := re.fullmatch(r"\[(\w+) ([^\]]+)\]", part):
                for i, w in enumerate(m[2].split()):
                    words.append(w)
                    tags.append(TAGS.index(("I-" if i else "B-") + m[1]))
            else:
                words.append(part)
                tags.append(0)
        out.append((words, tags))
    return out


def train(steps: int = 400, rate: float = 0.3, decay: float = 5e-4, caution: tuple[float, float] = (1.5, 0.5)) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of the labelled sentences; the gradient is observed less expected counts (forward-backward). caution is
    taken off the first word of a name and of a number in decoding: the labelled sentences hold far more of them than texts do."""
    data = labelled()
    known: dict[tuple[str, str], int] = {}
    coded = [[known.setdefault(feature(w), len(known) + 2) for w in words] for words, _ in data]
    longest, n, k = max(map(len, coded)), len(TAGS), len(known) + 2
    x, y, real = np.full((len(data), longest + 2), EDGE), np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool)
    for i, (c, (_, tags)) in enumerate(zip(coded, data, strict=True)):
        x[i, 1 : len(c) + 1], y[i, : len(c)], real[i, : len(c)] = c, tags, True
    near = [x[:, p : p + longest] for p in range(3)]
    params = [np.zeros((3, k, n)), np.zeros((n, n)), np.zeros(n)]
    allowed = np.zeros((n, n))
    for a, s in enumerate(TAGS):
        for b, t in enumerate(TAGS):
            if t[0] == "I" and s[1:] != t[1:]:
                allowed[a, b] = -50
    start = np.array([-50.0 if t[0] == "I" else 0.0 for t in TAGS])
    lse = lambda v, axis: np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis)) + v.max(axis=axis)
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, moves, first = params[0], params[1] + allowed, params[2] + start
        e = sum(w[p][near[p]] for p in range(3))
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(real[:, t, None], lse(f[:, t - 1, :, None] + moves, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(real[:, t + 1, None], lse(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        g = [-decay * len(data) * p for p in params]
        gap = (np.eye(n)[y] - np.exp(f + b - z[:, None, None])) * real[:, :, None]
        for p in range(3):
            np.add.at(g[0][p], near[p], gap)
        for t in range(1, longest):
            m = real[:, t]
            pair = np.exp(f[m, t - 1, :, None] + moves + (e[m, t] + b[m, t])[:, None, :] - z[m, None, None])
            g[1] -= pair.sum(axis=0)
            np.add.at(g[1], (y[m, t - 1], y[m, t]), 1)
        for i, p in enumerate(params):
            mean[i] = 0.9 * mean[i] + 0.1 * g[i]
            square[i] = 0.999 * square[i] + 0.001 * g[i] ** 2
            p += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    weights = params[0].copy()
    weights[:, 0] = 0
    weights[:, 0, 1:] = -1.5  # what training lacks speaks against a label
    begins = np.array([caution[t[2:] == "number"] if t[0] == "B" else 0.0 for t in TAGS])
    return Field(known, weights, params[1] + allowed - begins, start - begins)


def viterbi(scores, real: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray | float = 0.0, block: int = 4096) -> np.ndarray:
    """The best tags of each row of a batch: scores (rows, places, tags), or a function that gives those of places from t to u; real marks the
    places that a row has (from its first on). first and last are added to the first and the last tag's score. The way is carried over
    all places, of which block have their scores at a time."""
    of = scores if callable(scores) else lambda t, u: scores[:, t:u]
    (rows, places), n = real.shape, len(moves)
    back = np.zeros((rows, places, n), np.int8)
    for s in range(0, places, block):
        part = of(s, min(places, s + block))
        for t in range(s, min(places, s + block)):
            if t == 0:
                at = first + part[:, 0]
                continue
            way = at[:, :, None] + moves
            back[:, t] = way.argmax(axis=1)
            at = np.where(real[:, t, None], way.max(axis=1) + part[:, t - s], at)
            back[:, t][~real[:, t]] = np.arange(n)
    tags = np.zeros((rows, places), np.int8)
    tags[:, -1] = (at + last).argmax(axis=1)
    for t in range(places - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(rows), t, tags[:, t]]
    return tags


def field_spans(field: Field, texts: list[str], cache: dict[str, int], block: int = 1 << 18) -> list[list[tuple[int, int, str]]]:
    """Spans that the field finds, in code points. They are those of one decoding of each whole text: words left out leave no room for a label."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    known = field.known
    if len(cache) > 300_000:
        cache.clear()

    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    for w in {w for ws in split for w in ws}.difference(cache):
        cache[w] = known.get(feature(w), 0)
    ids = np.fromiter(map(cache.__getitem__, (w for ws in split for w in ws)), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    lo_of, hi_of = begins[owner], (begins + sizes)[owner]
    # What a label can add to the score at most over none on its words: own scores, and moves in, on and out, whatever stands beside it.
    first, inner = [i for i, t in enumerate(TAGS) if t[0] == "B"], [i for i, t in enumerate(TAGS) if t[0] == "I"]
    enter = (field.moves - field.moves[:, :1]).max(axis=0)
    leave = max(0.0, (field.moves - field.moves[0])[1:, [0, *first]].max())
    bonus = [np.maximum(enter, field.first - field.first[0])[first] + leave, (field.moves.max(axis=0) - field.moves[0, 0])[inner]]
    bounds = [field.weights[:, :, tags] - field.weights[:, :, :1] for tags in (first, inner)]
    low, high = np.zeros(len(ids)), np.zeros(len(ids))
    pad = np.concatenate(([EDGE], ids, [EDGE]))
    # A text's edge may give more than its neighbour's word does.
    inside = [pad[:-2].copy(), pad[2:].copy()]
    full = sizes > 0
    inside[0][begins[full]] = EDGE
    inside[1][(begins + sizes)[full] - 1] = EDGE
    for s in range(0, len(ids), block):
        e = min(len(ids), s + block)
        for k, gain in enumerate((low, high)):
            gain[s:e] = (bounds[k][0][inside[0][s:e]] + bounds[k][1][ids[s:e]] + bounds[k][2][inside[1][s:e]] + bonus[k]).max(axis=1)
    # live: words that some label could cover with gain, begun at or before them and going on as long as that pays. Labels on others only
    # lose, so each run of live words can be decoded by itself, with none on both sides, as in one pass over the text.
    total = np.concatenate(([0.0], np.cumsum(high)))
    after = np.maximum.accumulate(total[::-1])[::-1][1:] - total[1:]
    here = np.maximum.accumulate(low - total[1:]) + total[1:] if len(ids) else low
    live = np.flatnonzero(here + after > -1e-6)
    if not len(live):
        return out
    new = np.concatenate(([True], (np.diff(live) > 1) | (np.diff(owner[live]) > 0)))
    begin, end = live[new], np.concatenate((live[np.flatnonzero(new)[1:] - 1], live[-1:])) + 1
    order = np.argsort(end - begin, kind="stable")
    marked: dict[int, list[tuple[int, int, str]]] = {}
    s = 0
    while s < len(order):
        rows = order[s : s + 2048]
        rows = rows[: max(1, int((np.arange(1, len(rows) + 1) * (end - begin)[rows] <= block).sum()))]
        s += len(rows)
        width = int((end - begin)[rows].max())

        def scores(t, u, rows=rows):
            place = np.minimum(begin[rows][:, None] + np.arange(t, u), len(ids) - 1)
            return field.weights[0][inside[0][place]] + field.weights[1][ids[place]] + field.weights[2][inside[1][place]]

        real = begin[rows][:, None] + np.arange(width) < end[rows][:, None]
        starts = np.where((begin[rows] == lo_of[begin[rows]])[:, None], field.first, field.moves[0])
        ends = np.where((end[rows] == hi_of[begin[rows]])[:, None], 0.0, field.moves[:, 0])
        tags = viterbi(scores, real, field.moves, starts, ends)
        tags[~real] = 0
        for r in np.flatnonzero(tags.any(axis=1)).tolist():
            t = 0
            while t < width:
                if (tag := int(tags[r, t])) == 0:
                    t += 1
                    continue
                u = t + 1
                while u < width and tags[r, u] and TAGS[tags[r, u]][0] == "I":
                    u += 1
                p = int(begin[rows[r]])
                marked.setdefault(int(owner[p]), []).append((p + t - int(begins[owner[p]]), p + u - int(begins[owner[p]]), TAGS[tag][2:]))
                t = u
    for d, found in marked.items():
        places = [m.span() for m in re.finditer(r"\S+", texts[d])]
        for a, b, kind in found:
            s, e = places[a][0], places[b - 1][1]
            s, e = bare(texts[d], s, e)
            if s < e:
                out[d].append((s, e, kind))
    return out


def bare(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without the signs of STRIP around it; brackets that have their other half inside stay."""
    while s < e and text[s] in STRIP and not (text[s] == "(" and ")" in text[s:e]):
        s += 1
    while e > s and text[e - 1] in STRIP and not (text[e - 1] == ")" and "(" in text[s:e]):
        e -= 1
    return s, e


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, in the order of KINDS; failing matches are dropped and not tried again."""
    out: list[tuple[int, int, str]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def clear_of(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of more that overlap none of base: a span is met if of the base spans that start before its end one reaches beyond its start. Each is looked up in the sorted base spans."""
    own = sorted(base)
    starts, reach = [s for s, _, _ in own], [0, *accumulate((e for _, e, _ in own), max)]
    return [m for m in more if reach[bisect_left(starts, m[1])] <= m[0]]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def find(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans): spans as array of (start, end, kind) in code points, by start, then kind in the order of KINDS.

    What the field finds is added where it overlaps no base span. Null and empty texts have none. One row for each row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or train())
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for base, more in zip(map(base_spans, texts), field_spans(shared.value, texts, cache), strict=True):
                base = base + clear_of(base, more)
                rows.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base, key=lambda x: (x[0], order[x[2]]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find()."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or stretch of overlapping ones, replaced by its kind in brackets."""
    out, at, last = [], 0, 0
    for s, e, kind in sorted(spans):
        if s >= last:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = last = max(last, e)
    return "".join([*out, text[at:]])


def mask(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data in text replaced by [KIND]; null texts stay null, other columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train())
    names = documents.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            texts = b.column(place).to_pylist()
            new = []
            for t, more in zip(texts, field_spans(shared.value, [t or "" for t in texts], cache), strict=True):
                spans = base_spans(t or "")
                new.append(t if t is None else masked(t, spans + clear_of(spans, more)))
            columns = list(b.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_arrow(documents, run, documents.schema)
