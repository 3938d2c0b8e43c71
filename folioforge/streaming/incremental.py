"""The incremental index as a stream: files that arrive are chunked and replace what their path had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_rows


def incremental_chunks(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Runs over all that is there and not yet done (availableNow) and returns the chunks of each path's newest version.

    The stream's checkpoint is the ledger of what is done; a batch that is run again overwrites its own folders. A path that comes again replaces what an
    earlier batch had of it, even if no chunk is left of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "text")
        chunk_rows(rows).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        rows.select("doc_id").distinct().write.mode("overwrite").parquet(f"{out}/paths/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    newest = spark.read.parquet(f"{out}/paths").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/chunks").join(newest, ["doc_id", "batch"]).drop("batch")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of each user's sessions; works on a stream (with the watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
