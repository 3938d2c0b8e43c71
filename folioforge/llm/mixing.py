"""Mixing sources to target weights by entropy balancing: Newton steps on the convex dual, then whole copies.

The texts are read once, for (source, size, hash) of each row; sources, size classes and the cuts between documents that are taken once
more and those that are not come from these, and the rows learn their number of copies by a join with a table of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TASK_ROWS, checkpoint, fitted, hot_join, map_arrow, shuffle_tasks

WORD = r"[^\x20\x09-\x0D]+"
#: Classes (source, size class) up to which their table is broadcast; about a thousand of a source.
MOST_SENT = 200_000
#: Octaves of size, each 64 of the classes.
OCTAVES = 32
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: str = "text") -> Column:
    """The words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """64 classes of size to an octave, which is the class shifted right by 6."""
    return F.floor(F.log2(size + F.lit(1)) * 64).cast("int")


def source_key(source: Column) -> Column:
    """The source as a string that null shares with no source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, u): u is a hash of id and text, by whose order rows of one class are taken."""
    return documents.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "text", F.lit(9)).alias("u"))


def _placed(own: DataFrame, number: int) -> DataFrame:
    """own (of number rows) with place, its rank from 0 by source, null last: ranks in ranges of sources and the ranges' counts, so that no task orders more than TASK_ROWS or a range."""
    ranges = own if number <= TASK_ROWS else own.repartitionByRange(shuffle_tasks(own.sparkSession), F.col("source").asc_nulls_last())
    ranges = ranges.sortWithinPartitions(F.col("source").asc_nulls_last())
    ranges = fitted(checkpoint(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.expr("_at & 8589934591L"))), number)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.groupBy("_range").count().select("_range", before.alias("_before"))  # a row for each task
    return ranges.join(F.broadcast(offsets), "_range").withColumn("place", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def targets(own: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row for each source.

    Sources by code point, null last, weigh weights in turn and share `share` of all sizes. A target stops at `most` times its source's
    size; the excess is shared again by weight until none is above. Each round is one sum over the sources that are still open.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    own = checkpoint(own)
    sources = own.count()
    placed = _placed(fitted(own, sources), sources)
    rows = fitted(checkpoint(placed.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))), sources)
    full = F.col("cap") <= 0
    level, number = 0.0, -1
    while True:
        total, held, open_weight, now = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == number or not open_weight:
            break
        level, number = (share * total - held) / open_weight, now
        full = F.lit(level) * F.col("weight") >= F.col("cap")
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _cells(classes: DataFrame) -> DataFrame:
    """(key, words) of (key, class, words): a source's words by octave of size, OCTAVES numbers."""
    octaves = classes.groupBy("key", F.shiftright("class", 6).alias("octave")).agg(F.sum("words").alias("words"))
    listed = octaves.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("octave", "words"))).alias("m"))
    return listed.select("key", F.transform(F.sequence(F.lit(0), F.lit(OCTAVES - 1)), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0)).cast("double")).alias("words"))


def tilted(words: np.ndarray, target: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Rates by source (rows) and octave: 2 / (1 + exp(-l[source] - mu[octave])), with the l of each source that meets its target, found by halving. Where the target is all that a source can
    give, or nothing, its rates are 2 or 0."""
    low, high = (np.full(len(words), x) for x in (-80.0, 80.0))
    rate = lambda x: 2 / (1 + np.exp(-np.clip(x[:, None] + mu, -700, 700)))
    for _ in range(64):
        middle = (low + high) / 2
        less = (words * rate(middle)).sum(axis=1) < target
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    most, out = 2 * words.sum(axis=1), rate((low + high) / 2)
    out[target >= most * (1 - 1e-12)] = 2.0
    out[target <= 0] = 0.0
    return out


class Balance(NamedTuple):
    """mu: the multipliers of the octaves; gap: the largest of the dual's gradient as a part of all targets; steps: Newton steps taken."""

    mu: np.ndarray
    gap: float
    steps: int


def solve(rows: DataFrame, soft: float = 1e-3, tolerance: float = 1e-10, max_steps: int = 40) -> Balance:
    """The multipliers of the octaves for rows (key, words, target), one a source.

    Entropy balancing under two sets of constraints over the same documents: each source gives its target, and each octave of size keeps its share of the words, so
    that a mix doesn't trade long documents for short ones. The least change, in the entropy of rates between 0 and 2 that is 0 at rate 1, tilts each document by exp(l[source] + mu[octave]). The first set holds
    exactly; the second may contradict it, so it is bought with `soft`, a square penalty on mu. Each Newton step on the convex dual is one aggregate over the sources: they take their own l for the current mu, and tasks send the
    gradient and Hessian that are left for mu (OCTAVES numbers and their square), which Spark adds up and the driver solves.
    """
    n = OCTAVES
    words, total, wanted = np.zeros(n), 0.0, 0.0
    for r in rows.select(F.posexplode("words").alias("at", "w"), "target").groupBy("at").agg(F.sum("w").alias("w"), F.sum("target").alias("t")).collect():
        words[r["at"]], wanted = r.w, r.t
    total = words.sum()
    if not total or not wanted:
        return Balance(np.zeros(n), 0.0, 0)
    mu, goal, weight, gap = np.zeros(n), words / total * wanted, soft * wanted, 0.0
    find = tilted

    for step in range(max_steps):

        def sums(batches: Iterator[pa.RecordBatch], mu=mu) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros(n), np.zeros((n, n))
            for b in batches:
                if len(b):
                    w, target = np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy(zero_copy_only=False)
                    rate = find(w, target, mu)
                    gradient += (w * rate).sum(axis=0)
                    d = w * rate * (1 - rate / 2)
                    open_ = d.sum(axis=1) > 0
                    d = d[open_]
                    hessian += np.diag(d.sum(axis=0)) - (d / d.sum(axis=1, keepdims=True)).T @ d
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((gradient, hessian.ravel()))], pa.list_(pa.float64()))], ["x"])

        found = np.zeros(n + n * n)
        for r in map_arrow(rows.select("words", "target"), sums, "x array<double>").select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            found[r["at"]] = r.v
        gradient = found[:n] - goal + weight * mu
        gap = float(np.abs(gradient).max() / wanted)
        if gap < tolerance:
            break
        move = np.linalg.solve(found[n:].reshape(n, n) + weight * np.eye(n), gradient)
        mu = mu - move * min(1.0, 2.0 / max(1e-300, np.abs(move).max()))
    return Balance(np.round(mu, 9), gap, step)


def balance(classes: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, source_size, target, rates) of classes (key, class, words) and goals (source, source_size, target): how often a document of a source is to be taken, by octave of its size."""
    named = goals.withColumn("key", source_key(F.col("source"))).select("key", "source_size", "target")
    rows = checkpoint(_cells(classes).join(named, "key"))
    rows = fitted(rows, rows.count())
    mu, find = solve(rows).mu, tilted

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = find(np.stack(b.column(1).to_numpy(zero_copy_only=False)), b.column(3).to_numpy(zero_copy_only=False), mu)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(np.round(found, 8)), pa.list_(pa.float64()))], ["key", "source_size", "target", "rates"])

    return map_arrow(rows.select("key", "words", "source_size", "target"), rates, "key string, source_size long, target double, rates array<double>")


def _dealt(counted: DataFrame) -> DataFrame:
    """(key, class, base, extra) of (key, class, n, words, source_size, target, rate): all rows of a size class of one source get base copies and extra of them one more. From the largest class down, what
    a class misses or exceeds of its words is carried to the smaller ones. A row gets 0 to 2 copies, so these can take up no more than 0 to twice their words: where that is too little, a class
    gets the number nearest to its own that leaves them what they can. A source has a thousand classes or so, so one row holds them."""
    row = F.struct((-F.col("class")).alias("c"), "n", F.col("words").cast("double").alias("w"), "rate")
    listed = counted.groupBy("key").agg(F.max("target").alias("target"), F.max("source_size").cast("double").alias("size"), F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.struct(F.lit(0.0).alias("carried"), F.col("target").alias("left"), F.col("size").alias("rest"), F.array().cast("array<struct<class:int,copies:bigint,n:bigint>>").alias("done"))

    def step(acc, x):
        mean, rest, left = x["w"] / x["n"], acc["rest"] - x["w"], acc["left"]
        by, wanted = F.nullif(mean, F.lit(0.0)), x["rate"] * x["w"] + acc["carried"]
        low, high = F.ceil((left - 2 * rest) / by - 1e-6), F.floor(left / by + 1e-6)  # high + 1 at most
        n = F.when(low <= high, F.greatest(low, F.least(high, F.round(wanted / by)))).when(left - high * mean - 2 * rest <= low * mean - left, high).otherwise(low)
        n = F.coalesce(n, F.round(x["rate"] * x["n"])).cast("bigint")
        n = F.least(2 * x["n"], F.greatest(n, F.lit(0).cast("bigint")))
        done = F.struct((-x["c"]).alias("class"), n.alias("copies"), x["n"].alias("n"))
        return F.struct((wanted - n * mean).alias("carried"), (left - n * mean).alias("left"), rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))

    return listed.select("key", F.inline(F.aggregate("rows", first, step)["done"])).select("key", "class", F.expr("copies div n").alias("base"), F.expr("copies % n").alias("extra"))


def plan(sized: DataFrame) -> DataFrame:
    """(key, class, n, source_size, target, rate, base, cut) of sizes(): rows of a class are taken base times, and once more if u <= cut.

    The cut of a class leaves as many of the smallest u on its side as _dealt() says. It is found in two steps, among ranges of u and then inside one, both about the
    square root of the largest class, from counts of equal u, so neither a large source, nor very many documents of one size, nor very many equal rows meet in one task.
    Rows of equal u are taken all or none, whichever comes nearer.
    """
    by = [source_key(F.col("source")).alias("key"), "source", size_class(F.col("size")).alias("class")]
    units = checkpoint(sized.groupBy(*by, "u").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    classes = checkpoint(sized.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    number, largest = classes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    classes = fitted(classes, number)
    sent = F.broadcast if number <= MOST_SENT else lambda df: df
    rates = checkpoint(balance(classes, targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))))
    own = classes.join(fitted(rates, rates.count()), "key").withColumn("rate", F.element_at("rates", F.shiftright("class", 6) + 1))
    counted = fitted(checkpoint(own.select("key", "class", "n", "words", "source_size", "target", "rate")), number)
    wanted = fitted(checkpoint(counted.join(_dealt(counted), ["key", "class"])), number)
    some = wanted.where("extra > 0 and extra < n").select("key", "class", "extra")
    in_range = F.shiftright("u", 64 - max(1, (int(largest).bit_length() + 1) // 2)).alias("range")
    cells = units.groupBy("key", "class", in_range).agg(F.sum("n").alias("here")).join(sent(some), ["key", "class"])
    upto = F.sum("here").over(Window.partitionBy("key", "class").orderBy("range"))
    reached = cells.withColumn("upto", upto).where("upto >= extra and upto - here < extra").select("key", "class", "range", (F.col("extra") - F.col("upto") + F.col("here")).alias("need"))
    inside = units.select("key", "class", in_range, "u", "n").join(sent(reached), ["key", "class", "range"])
    upto = F.sum("n").over(Window.partitionBy("key", "class").orderBy("u"))
    last = inside.withColumn("upto", upto).where("upto >= need and upto - n < need")
    cuts = last.select("key", "class", F.when(2 * (F.col("upto") - F.col("need")) <= F.col("n"), F.col("u")).otherwise(F.col("u") - 1).alias("cut"))
    cut = F.when(F.col("extra") <= 0, F.lit(None).cast("long")).when(F.col("extra") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("cut"))
    return fitted(checkpoint(wanted.join(sent(cuts), ["key", "class"], "left").select("key", "class", "n", "source_size", "target", "rate", "base", cut.alias("cut"))), number)


def _with_plan(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the column _class, a struct (key, class), and their class's plan: its columns follow."""
    facts = classes.select(F.struct("key", "class").alias("_class"), F.struct("n", "source_size", "target", "rate", "base", "cut").alias("_plan"))
    number = classes.count()
    if number <= MOST_SENT:
        return rows.join(F.broadcast(facts), "_class")
    return hot_join(rows, facts, "_class", F.col("_plan.n"), classes.agg(F.sum("n")).first()[0])


def _copies(u: Column) -> Column:
    return (F.col("_plan.base") + F.coalesce((u <= F.col("_plan.cut")).cast("long"), F.lit(0))).cast("long")


def shares(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) of each row; taken is copies * size.

    Null and empty texts have size 0; null ids and repeated rows are taken like others, in the order of a hash of id and text; an empty
    table gives none. The hash and the counts decide, so reruns agree however the rows are dealt out.
    """
    sized = checkpoint(sizes(documents))
    found = _with_plan(sized.withColumn("_class", F.struct(source_key(F.col("source")).alias("key"), size_class(F.col("size")).alias("class"))), plan(sized))
    return found.select("doc_id", "size", "_plan.source_size", "_plan.target", "_plan.rate", _copies(F.col("u")).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(documents: DataFrame) -> DataFrame:
    """The documents with size, source_size, target, rate, copies and taken, as shares() has them; texts are not shuffled. Columns of these names are replaced, all others stay."""
    own = documents.drop(*RESULTS)
    classes = plan(checkpoint(sizes(own)))
    rows = own.select(F.struct(*own.columns).alias("_row"), word_count().alias("_size"), F.xxhash64("doc_id", "text", F.lit(9)).alias("_u"), source_key(F.col("source")).alias("_key"))
    rows = rows.select("_row", "_size", "_u", F.struct(F.col("_key").alias("key"), size_class(F.col("_size")).alias("class")).alias("_class"))
    found = _with_plan(rows, classes)
    return found.select("_row.*", F.col("_size").alias("size"), "_plan.source_size", "_plan.target", "_plan.rate", _copies(F.col("_u")).alias("copies"), (_copies(F.col("_u")) * F.col("_size")).alias("taken"))
