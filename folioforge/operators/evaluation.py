"""Evaluation: retrieval metrics, agreement, and checks of ledgers against each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(query, hits, recall, mrr, dcg, judged) at k. hits: (query, rank, relevance; null: unjudged); relevant: (query, n_relevant)."""
    top = hits.where(F.col("rank") <= k)
    gain = (F.pow(F.lit(2.0), F.coalesce("relevance", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)
    good = F.coalesce(F.col("relevance"), F.lit(0)) > 0
    by = top.groupBy(query).agg(F.count_if(good).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("_first"), F.sum(gain).alias("dcg"), F.count("relevance").alias("judged"))
    return by.join(relevant, query).select(query, "hits", (F.col("hits") / F.col("n_relevant")).alias("recall"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), "dcg", "judged")


def macro_average(scores: DataFrame, domain: str, value: str) -> DataFrame:
    """The mean over domains of the means over their queries."""
    return scores.groupBy(domain).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias("macro"), F.count("*").alias("domains"))


def weighted_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Linear weighted kappa of two assessors' whole-number grades, from their confusion counts."""
    cells = pairs.groupBy(a, b).count()
    left = cells.groupBy(F.col(a).alias("x")).agg(F.sum("count").alias("nx"))
    right = cells.groupBy(F.col(b).alias("y")).agg(F.sum("count").alias("ny"))
    seen = cells.agg(F.sum(F.abs(F.col(a) - F.col(b)) * F.col("count")).alias("observed"), F.sum("count").alias("n"))
    # Grades are few: the marginals are a handful of rows each.
    expected = F.broadcast(left).join(F.broadcast(right)).agg(F.sum(F.abs(F.col("x") - F.col("y")) * F.col("nx") * F.col("ny")).alias("chance"))
    return seen.crossJoin(expected).select((1 - F.col("observed") * F.col("n") / F.col("chance")).alias("kappa"), "n")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, rule: str) -> DataFrame:
    """(rule, id, n): values of key without a parent, nulls left out."""
    missing = rows.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col(parent_key), "left_anti")
    return missing.groupBy(F.col(key).cast("string").alias("id")).count().select(F.lit(rule).alias("rule"), "id", F.col("count").alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_gain(hits: DataFrame, query: str, evidence: str) -> DataFrame:
    """Adds gain: 1 for the best ranked hit of each piece of evidence, 0 for later ones."""
    w = Window.partitionBy(query, evidence).orderBy("rank")
    return hits.withColumn("gain", F.when(F.row_number().over(w) == 1, 1).otherwise(0))


def bootstrap_interval(pairs: DataFrame, cluster: str, a: str, b: str, samples: int = 1000, seed: int = 7) -> DataFrame:
    """(low, mean, high): the 95 % interval of the mean of the paired difference a - b, clusters resampled with Poisson(1) weights drawn from a hash.

    Weights depend on (cluster, sample) alone, so every row gets its own without a shuffle; each sample is one row after the partial sums.
    """
    sums = pairs.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("n"))
    drawn = sums.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digest = F.md5(F.concat_ws("|", F.col(cluster).cast("string"), F.col("sample").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = sum(F.when(u >= e, 1).otherwise(0) for e in poisson_edges())
    means = drawn.groupBy("sample").agg((F.sum(weight * F.col("s")) / F.nullif(F.sum(weight * F.col("n")), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("high"))


def poisson_edges(most: int = 6) -> list[float]:
    """P(X <= k) of a Poisson variable of mean 1."""
    edges, term, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += term
        edges.append(total)
        term /= k + 1
    return edges


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """(alpha, n_values, n_units): agreement of any number of assessors on ordinal whole-number grades, from ratings (unit, value); gaps are rows that are not there or null.

    Units of one value say nothing. Each unit adds its pairs of values, weighted by one over its values less one, to a coincidence matrix, whose size is the square of the number of grades and
    no more; distances follow from its margins. alpha is null if all values are alike.
    """
    counts = ratings.where(F.col(unit).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    units = counts.groupBy("u").agg(F.sum("n").alias("m"), F.collect_list(F.struct("v", "n")).alias("x")).where("m > 1")  # a unit's grades, at most as many as there are
    pairs = units.select("m", F.explode("x").alias("a"), "x").select("m", "a", F.explode("x").alias("b"))
    share = F.col("a.n") * (F.col("b.n") - (F.col("a.v") == F.col("b.v")).cast("int")) / (F.col("m") - 1)
    cells = pairs.groupBy(F.col("a.v").alias("c"), F.col("b.v").alias("k")).agg(F.sum(share).alias("o"))
    margins = cells.groupBy("c").agg(F.sum("o").alias("n")).select("c", "n", F.sum("n").over(Window.orderBy("c")).alias("upto"))  # a row for each grade
    left, right = (margins.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("upto").alias(f"t{x}")) for x in ("c", "k"))
    between = F.abs(F.col("tk") - F.col("tc")) + F.when(F.col("k") >= F.col("c"), F.col("nc")).otherwise(F.col("nk")) - (F.col("nc") + F.col("nk")) / 2
    far = F.when(F.col("c") != F.col("k"), between * between).otherwise(0.0)
    # Grades are few: both margins are a handful of rows each.
    grid = F.broadcast(left).join(F.broadcast(right)).join(cells, ["c", "k"], "left").agg(F.sum(F.coalesce("o", F.lit(0.0)) * far).alias("seen"), F.sum(F.col("nc") * F.col("nk") * far).alias("chance"))
    size = units.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_values"), F.count("*").alias("n_units"))
    return grid.crossJoin(F.broadcast(size)).select((1 - (F.col("n_values") - 1) * F.col("seen") / F.nullif(F.col("chance"), F.lit(0.0))).alias("alpha"), "n_values", "n_units")


def drawn_means(rows: DataFrame, experiment: str, domain: str, cluster: str, base: str, candidate: str, samples: int = 1000, seed: int = 7) -> DataFrame:
    """(experiment, sample, delta, base): for each sample of clusters the mean over domains of the paired difference candidate - base, and of base.

    Clusters (all queries of a paper or source) are drawn within their domain by Poisson(1) weights from a hash of cluster and sample. A cluster's weights are worked out once, in the one row that
    lists its sums by experiment and domain; there a task multiplies them, and it sends a row for each experiment, domain and sample. Rows without a cluster are left out.
    """
    sums = rows.where(F.col(cluster).isNotNull()).groupBy(experiment, domain, cluster).agg(F.sum(F.col(candidate) - F.col(base)).cast("double").alias("d"), F.sum(base).cast("double").alias("b"), F.count("*").cast("double").alias("n"))
    draw = lambda sample: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(cluster).cast("string"), sample.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = lambda u: sum(F.when(u >= e, 1).otherwise(0) for e in poisson_edges()).cast("byte")
    listed = sums.groupBy(cluster).agg(F.collect_list(F.struct(F.col(experiment).alias("e"), F.col(domain).alias("m"), "d", "b", "n")).alias("x"))
    weighted = listed.select("x", F.transform(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), draw), weight).alias("w"))

    def run(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
        totals, seen, kinds = {}, {}, None

        def out() -> Iterator[pa.RecordBatch]:
            for key, total in totals.items():
                lists = [pa.array([k] * samples, kind) for k, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(np.arange(samples, dtype=np.int32)), *(pa.array(t) if s else pa.nulls(samples, pa.float64()) for t, s in zip(total, seen[key], strict=True))], [experiment, domain, "sample", "d", "b", "n"])
            totals.clear()

        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                e, m, *values = b.column(0).flatten().flatten()
                kinds = (e.type, m.type)
                w = b.column(1).flatten().to_numpy().reshape(len(b), samples).astype(float)
                values = np.array([v.to_numpy(zero_copy_only=False) for v in values]), np.array([v.is_valid().to_numpy(zero_copy_only=False) for v in values])
                values = np.where(values[1], values[0], 0.0), values[1]  # sums leave nulls out
                parent, of = np.repeat(np.arange(len(b)), b.column(0).value_lengths().to_numpy()), {}
                for i, key in enumerate(zip(e.to_pylist(), m.to_pylist(), strict=True)):
                    of.setdefault(key, []).append(i)
                for key, own in of.items():
                    part = values[0][:, own] @ w[parent[own]]
                    there = values[1][:, own].any(axis=1)
                    seen[key] = seen[key] | there if key in totals else there
                    totals[key] = totals[key] + part if key in totals else part
                if len(totals) > most:
                    yield from out()
        yield from out()

    kind = lambda c: sums.schema[c].dataType.simpleString()
    drawn = weighted.mapInArrow(run, f"{experiment} {kind(experiment)}, {domain} {kind(domain)}, sample int, d double, b double, n double")
    means = drawn.groupBy(experiment, domain, "sample").agg(*[(F.sum(x) / F.nullif(F.sum("n"), F.lit(0.0))).alias(x) for x in ("d", "b")])
    return means.groupBy(experiment, "sample").agg(F.avg("d").alias("delta"), F.avg("b").alias("base"))


def release_gates(rows: DataFrame, experiment: str, domain: str, cluster: str, slice_of: str, samples: int = 1000, gain: float = 0.05, drop: float = 0.02, slower: float = 1.5) -> DataFrame:
    """One row for each experiment: its figures, a pass or fail for each gate, and the decision. rows: (experiment, domain, cluster, slice, primary_base, primary_candidate,
    guard_base, guard_candidate, ms_base, ms_candidate), one a query.

    Gates: primary, a mean over domains that is up by `gain` of the base at least (by `gain` itself if the base is 0) with a 95 % interval of the paired difference above 0; guard, a mean that is down by
    `drop` at most; slices, none down by more in the primary metric; latency, a p95 of `slower` times the base's at most. ship if all pass; owner if only slices or latency fail, which
    someone must accept; else reject.
    """
    draws = drawn_means(rows, experiment, domain, cluster, "primary_base", "primary_candidate", samples)
    interval = draws.groupBy(experiment).agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"))
    by_domain = rows.groupBy(experiment, domain).agg(F.avg("primary_base").alias("b"), F.avg(F.col("primary_candidate") - F.col("primary_base")).alias("d"), F.avg(F.col("guard_base") - F.col("guard_candidate")).alias("g"))
    macro = by_domain.groupBy(experiment).agg(F.avg("b").alias("base"), F.avg("d").alias("delta"), F.avg("g").alias("guard_drop"))
    slices = rows.groupBy(experiment, slice_of).agg(F.avg(F.col("primary_base") - F.col("primary_candidate")).alias("s")).groupBy(experiment).agg(F.max("s").alias("slice_drop"))
    speed = rows.groupBy(experiment).agg(F.percentile("ms_base", 0.95).alias("p95_base"), F.percentile("ms_candidate", 0.95).alias("p95_candidate"))
    told = interval.join(macro, experiment).join(slices, experiment).join(speed, experiment)
    wanted = F.when(F.col("base") == 0, F.lit(gain)).otherwise(gain * F.col("base"))
    told = told.withColumn("primary_ok", (F.col("delta") >= wanted) & (F.col("low") > 0)).withColumn("guard_ok", F.col("guard_drop") <= drop).withColumn("slices_ok", F.col("slice_drop") <= drop).withColumn("latency_ok", F.col("p95_candidate") <= slower * F.col("p95_base"))
    decision = F.when(~(F.col("primary_ok") & F.col("guard_ok")), "reject").when(F.col("slices_ok") & F.col("latency_ok"), "ship").otherwise("owner")
    return told.withColumn("decision", decision)
