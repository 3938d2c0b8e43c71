"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent.parent)
#: What one Arrow batch holds at most, beside its rows: a batch of long texts then fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Keys that hold more than one in HOT of all rows are joined by broadcast; there are fewer than HOT of them, whatever the input.
HOT = 10_000
#: Rows of a table of a few numbers each that one task takes.
TASK_ROWS = 20_000


def importable(spark: SparkSession) -> None:
    """Python workers find the package where the driver has it, whatever folder the driver was started in."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow() in batches that fit a worker."""
    spark = df.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session of one machine (tests) may do without and gets a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df, a checkpoint of so many rows, in as many partitions as they need, however many tasks made it: a table of TASK_ROWS at most is one partition, over
    which sums, windows and joins with its like need no shuffle. For tables that may be far smaller than what they come from."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: Column, total: int) -> DataFrame:
    """Inner join of rows (total of them, about) with facts on key, where facts has one row for each key and count its number of rows.

    The facts of keys with over total / HOT rows are broadcast, so rows of a hot key stay where they are; by their number
    that table is below HOT rows at any size. The other keys, none of them large, are joined by a shuffle.
    """
    hot = count > max(8, total // HOT)
    marked = rows.join(F.broadcast(facts.where(hot).select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    warm = marked.where("_hot is not null").drop("_hot").join(F.broadcast(facts.where(hot)), key)
    return warm.unionByName(marked.where("_hot is null").drop("_hot").join(facts.where(~hot), key))


def counted_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """hot_join() where facts (one row for each key) lacks the number of rows: they are counted by key first, which combines before its shuffle. Only keys of facts count."""
    counts = checkpoint(rows.groupBy(key).agg(F.count("*").alias("_rows")).join(facts.select(key), key, "left_semi"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    return hot_join(rows, facts.join(counts, key), key, F.col("_rows"), total).drop("_rows")
