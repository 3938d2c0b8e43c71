"""Readers. Parquet keeps filters and columns at the scan; text sources keep a line's place from the source."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with null text and url empty, lang und and source none (or only the named of these): what lacks is judged like what is empty, and no row is left out."""
    empty = {"text": "", "url": "", "lang": "und", "source": "none"}
    return rows.fillna({c: v for c, v in empty.items() if c in (columns or rows.columns)})


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session of one machine (tests) may do without and gets a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, for rows that several parts of a plan read."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of a vault that hold no live notes, by prefix of the relative path and by part of it.
EXCLUDED_PREFIXES = (
    "progress/gate_backups/",
    "progress/gate_reports/",
    "progress/version_snapshots/",
    "progress/schema_migration/",
    "progress/taxonomy_discovery/",
    "progress/pipeline_logs/",
    "progress/pipeline_reports/",
)
EXCLUDED_PARTS = (".claude", ".obsidian", "__pycache__", ".stfolder")


def live_note(relative: Column) -> Column:
    """Whether a path relative to the vault's root is that of a live note."""
    parts = F.split(relative, "/")
    hidden = F.exists(parts, lambda p: p.isin(*EXCLUDED_PARTS) | p.startswith(".tmp"))
    prefixed = F.lit(False)
    for x in EXCLUDED_PREFIXES:
        prefixed = prefixed | relative.startswith(x)
    return ~prefixed & ~hidden


def notes(spark: SparkSession, root: str, recursive: bool = True, suffix: str = "_review_note.md") -> DataFrame:
    """(path, content) of the live Markdown notes below root."""
    own = spark.newSession()  # for what opening a file counts, which no reader has an option for: notes are small, and by the default some 30 make a task
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.openCostInBytes", "8k")
    files = own.read.text(root, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=f"*{suffix}")
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    bare = "^[a-z]+:/*"  # a scheme, which paths have and root may have
    below = F.regexp_replace(F.col("path"), bare, "/")
    return rows.where(live_note(F.regexp_replace(below, "^\\Q" + re.sub(bare, "/", root).rstrip("/") + "\\E/", "")))


def write_notes(rows: DataFrame, root: str) -> None:
    """Writes rows (folder, text) below root, each as one text file with a line end after it.

    In a folder of the file system that driver and executors share, tasks write the files themselves, each into folders of its own: Spark's writer took some 20 ms a file there.
    Names follow the place in the partition, so a task that is run again writes the same files. Elsewhere Spark writes.
    """
    if re.match("[a-z0-9]+:", root) and not root.startswith("file:"):
        for r in rows.select("folder").distinct().collect():
            rows.where(F.col("folder") == r.folder).select("text").write.option("maxRecordsPerFile", 1).text(f"{root}/{r.folder}")
        return
    at = re.sub("^file:/*", "/", root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, known = TaskContext.get().partitionId(), 0, set()
        for b in batches:
            for folder, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = f"{at}/{folder}/{task:05d}"
                if own not in known:
                    os.makedirs(own, exist_ok=True)
                    known.add(own)
                with open(f"{own}/{n:07d}.txt", "wb") as f:
                    f.write(f"{text}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select("folder", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def ledger_set(lines: DataFrame, column: str = "value") -> DataFrame:
    """(value): the distinct lines of a ledger, trimmed, blank ones left out."""
    return lines.select(F.trim(column).alias("value")).where("value <> ''").distinct()


def ledger_last_wins(lines: DataFrame) -> DataFrame:
    """(name, digest) of lines `name<tab>digest` (seq, line): a later line overrides; without a tab the digest is empty."""
    parts = lines.where(F.trim("line") != "").select("seq", F.split_part("line", F.lit("\t"), F.lit(1)).alias("name"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("digest"))
    return parts.groupBy("name").agg(F.max_by("digest", "seq").alias("digest"))


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(line_no, record, error) of lines (line_no, value): blank lines are left out, a line that is no JSON object is an error."""
    clean = F.regexp_replace(F.trim("value"), "^﻿", "")
    rows = lines.select("line_no", clean.alias("value")).where("value <> ''")
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("record", record)
    bad = F.when(F.col("record._corrupt_record").isNotNull() | ~F.col("value").startswith("{"), F.lit("not a JSON object"))
    return rows.select("line_no", "record", bad.alias("error"))
