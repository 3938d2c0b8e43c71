"""Connected components of a link table, without ever holding a component or a node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_join


def _star(both: DataFrame, number: int, large: bool) -> DataFrame:
    """One star step. both: (u, v), the neighbours v of u that count besides u. Every edge of u is put on the least of u and its neighbours: in the large
    step its larger neighbours, in the small step its smaller ones and u itself."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    met = hot_join(both, least, "u", F.col("n"), number)
    if large:
        return met.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    moved = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable. Ids that no link names are left out; self links and repeats are harmless. Ids are whole numbers.

    Alternating star steps: neighbours larger than a node move to its least neighbour, then a node and its smaller neighbours do. Each step is an
    aggregate, combined before its shuffle, and a join with its result, in which nodes of very many links are joined by a bounded broadcast.
    The number of rounds grows with the logarithm of a component's size. Edges that no longer change are stars, and end the rounds.
    """
    one = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = checkpoint(one.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen, number = None, edges.count()
    while number:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        grown = checkpoint(_star(both, 2 * number, large=True))
        edges = checkpoint(_star(grown.select(F.col("a").alias("u"), F.col("b").alias("v")), number, large=False))
        state = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, number = state, state[0]
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
