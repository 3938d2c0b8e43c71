"""A vector index in cells: a coarse quantizer deals vectors into partitions of Parquet, a search reads the cells near its queries and scores their members exactly.

Vectors are compared by cosine. A cell knows the widest angle of a member to its center, so a search can also go on until no unread cell can hold a better
member: then its result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpoint
from .search import ranked

#: Vectors of a cell and queries that one task multiplies at once; larger cells and more queries are dealt out.
TILE, BLOCK = 8192, 1024
#: Vectors a cell that train the quantizer; more are not needed for its centers, and all are indexed.
TRAINED = 256
#: Members whose true neighbours tell how many cells a search must read.
CALIBRATED = 200
#: Angles (radians) that differ by less count as equal.
NEAR = 1e-6


class Cells(NamedTuple):
    """Unit vectors of the centers, each cell's widest angle, and its number of members; probes: cells that a search reads."""

    centers: np.ndarray
    width: np.ndarray
    size: np.ndarray
    probes: int


def directed(vectors: DataFrame, id_column: str, vector: str = "embedding") -> DataFrame:
    """(id, x) of vectors that have a direction: null ones, zero ones and those with null or non-finite components are left out."""
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return vectors.select(F.col(id_column).alias("id"), x.alias("x")).where((F.size("x") > 0) & (length > 0) & (length < float("inf")))


def train(rows: DataFrame, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centers of (id, x) by spherical k-means: each round is one scan of a sample of about TRAINED rows a cell, drawn by a hash; tasks send sums, and Spark adds them up by cell.

    The driver holds the centers only. A cell without members keeps its center.
    """
    number = rows.count()
    share = min(1.0, TRAINED * cells / max(1, number))
    sample = checkpoint(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("id", "x"))
    first = sample.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(cells).select("x").collect()
    centers = np.array([r[0] for r in first], float)
    for _ in range(rounds if len(centers) > 1 else 0):
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)

        def sums(batches: Iterator[pa.RecordBatch], centers=centers) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
            for b in batches:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, centers.shape[1]))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cell = (x @ centers.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(centers))
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total[own]), pa.list_(pa.float64()))], ["cell", "total"])

        moved = sample.select("x").mapInArrow(sums, "cell long, total array<double>").select("cell", F.posexplode("total").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v"))
        fresh = centers.copy()
        for r in moved.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("l")).select("cell", F.col("l.v").alias("v")).collect():
            if np.linalg.norm(r.v) > 0:
                fresh[r.cell] = r.v
        centers = fresh
    return centers / np.linalg.norm(centers, axis=1, keepdims=True) if len(centers) else centers


def write(vectors: DataFrame, id_column: str, path: str, cells: int | None = None, vector: str = "embedding", k: int = 10, recall: float = 0.98) -> None:
    """Trains a quantizer (about the square root of the rows as cells, 4096 at most) and writes all vectors by cell below path.

    How many cells a search reads is calibrated: of CALIBRATED members, drawn by a hash, the k nearest are found exactly, and that many of a member's nearest cells are read that
    they hold the share `recall` of these.
    """
    rows = directed(vectors, id_column, vector)
    number = rows.count()
    centers = train(rows, cells or max(1, min(4096, round(number**0.5))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                cosine = x @ centers.T / np.linalg.norm(x, axis=1, keepdims=True)
                cell = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))), pa.array(cell)], ["id", "x", "angle", "cell"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"id {kind}, x array<double>, angle double, cell long").hint("rebalance", "cell")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
    spark = vectors.sparkSession
    known = spark.read.schema(f"id {kind}, x array<double>, angle double, cell long").parquet(f"{path}/members").groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("width"))
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell long, center array<double>")
    named.join(known, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    numbers, found = load(spark, path)
    asked = spark.createDataFrame([tuple(r) for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATED).collect()], rows.schema)
    _calibrate(spark, path, numbers, found, asked, k, recall)


def _calibrate(spark: SparkSession, path: str, numbers: list[int], cells: Cells, asked: DataFrame, k: int, recall: float) -> None:
    """Writes how many of a query's nearest cells hold the share recall of the true neighbours of the asked (id, x)."""
    probes = 1
    if numbers:
        true = search(spark, path, asked.select(F.col("id").alias("q"), "x"), "q", k, 1, True, vector="x").select("q", "id")
        homes = spark.read.parquet(f"{path}/members").select("id", "cell").join(F.broadcast(true), "id").select("q", "cell").collect()
        of = {r.id: np.array(r.x) for r in asked.collect()}
        order = {q: {numbers[c]: place for place, c in enumerate(np.argsort(-(cells.centers @ x), kind="stable"))} for q, x in of.items()}
        places = np.sort([order[r.q][r.cell] for r in homes])
        probes = int(places[min(len(places) - 1, int(recall * len(places)))]) + 1
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def load(spark: SparkSession, path: str) -> tuple[list[int], Cells]:
    """The cells' numbers and what is known of them: a row a cell, so bounded by their number."""
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    try:
        probes = spark.read.parquet(f"{path}/probes").first().probes
    except AnalysisException:  # while it is being written
        probes = 1
    return [r.cell for r in rows], Cells(np.array([r.center for r in rows], float), np.array([r.width for r in rows], float), np.array([r["size"] for r in rows], np.int64), probes)


def members(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """The members of the wanted cells; only their folders are read. The folders' names are read as int, and as such cell would hash to other partitions than a long."""
    return spark.read.parquet(f"{path}/members").where(F.col("cell").isin(wanted)).withColumn("cell", F.col("cell").cast("long"))


def _probing(asked: DataFrame, numbers: list[int], cells: Cells, probes: int) -> DataFrame:
    """(q, x, cell, floor) of asked (q, x, floor): with a null floor the nearest `probes` cells, else those beyond them that may hold a member of a cosine of floor or more."""
    centers, width, known = cells.centers, cells.width, np.array(numbers, np.int64)  # plain arrays: workers need nothing of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not len(known):
                continue
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
            cosine = x @ centers.T / np.linalg.norm(x, axis=1, keepdims=True)
            order = np.argsort(-cosine, axis=1, kind="stable")
            near = np.zeros(cosine.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            floor = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            least = np.arccos(np.clip(cosine, -1, 1)) - width - NEAR
            row, cell = np.nonzero(np.where(np.isnan(floor)[:, None], near, ~near & (least <= np.arccos(np.clip(floor, -1, 1))[:, None])))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(known[cell]), b.column(2).take(taken)], ["q", "x", "cell", "floor"])

    return asked.select("q", "x", "floor").mapInArrow(run, f"q {asked.schema['q'].dataType.simpleString()}, x array<double>, cell long, floor double")


def _scored(spark: SparkSession, path: str, numbers: list[int], cells: Cells, probing: DataFrame, k: int, digits: int) -> DataFrame:
    """(q, id, score): the best k members of each tile for each (q, cell). One pass: a cell's tiles meet the blocks of its queries, both of bounded size."""
    load_of = probing.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tiles = spark.createDataFrame([(c, int(-(-n // TILE))) for c, n in zip(numbers, cells.size.tolist(), strict=True)], "cell long, tiles int")
    facts = checkpoint(load_of.join(F.broadcast(tiles), "cell"))
    wanted = [r.cell for r in facts.select("cell").collect()]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members(spark, path, wanted).join(F.broadcast(facts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), each("blocks").alias("block"), "id", "x")
    right = probing.join(F.broadcast(facts), "cell").select("cell", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), each("tiles").alias("tile"), "q", "x")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["q", "id", "score"]
        if not len(a) or not len(b):
            return pa.Table.from_arrays([b.column("q").slice(0, 0), a.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        x, y = (np.stack(t.column("x").combine_chunks().to_numpy(zero_copy_only=False)) for t in (a, b))
        score = y @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)[:, None]
        score = np.trunc(score * 10.0**digits + np.copysign(0.5, score)) / 10.0**digits  # halves away from zero, as SQL rounds
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else score.min(axis=1)
        row, col = np.nonzero(score >= least[:, None])  # ties stay
        return pa.Table.from_arrays([b.column("q").take(pa.array(row)), a.column("id").take(pa.array(col)), pa.array(score[row, col])], names)

    key = ["cell", "tile", "block"]
    schema = f"q {probing.schema['q'].dataType.simpleString()}, id {left.schema['id'].dataType.simpleString()}, score double"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)


def search(spark: SparkSession, path: str, asked: DataFrame, query_id: str, k: int, probes: int | None = None, exact: bool = False, digits: int = 6, vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k members of the largest cosine, rounded, for each asked vector; ties by id.

    The nearest `probes` cells are read, as many as the index was calibrated to if null. With exact, so are the others that may hold a better member than the k-th of these, and the result is that of a full scan. Queries without a direction have no hits.
    """
    numbers, cells = load(spark, path)
    probes = probes or cells.probes
    queries = checkpoint(directed(asked, query_id, vector).select(F.col("id").alias("q"), "x"))
    first = checkpoint(_probing(queries.withColumn("floor", F.lit(None).cast("double")), numbers, cells, probes))
    found = _scored(spark, path, numbers, cells, first, k, digits)
    if exact:
        found = checkpoint(ranked(found, "q", [F.desc("score"), F.col("id")], k).select("q", "id", "score"))
        floors = found.groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select("q", F.when(F.col("n") >= k, F.col("floor") - 10.0**-digits).otherwise(-1.0).alias("floor"))
        more = checkpoint(_probing(queries.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))), numbers, cells, probes))
        found = found.unionByName(_scored(spark, path, numbers, cells, more, k, digits))
    return ranked(found, "q", [F.desc("score"), F.col("id")], k).select(F.col("q").alias(query_id), "id", "score", "rank")
