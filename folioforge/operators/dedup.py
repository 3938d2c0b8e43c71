"""Deduplication of groups, prefilters of work already done, and audits of ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, signature: str, order: str) -> DataFrame:
    """One row of each signature, the first by `order` and then by the other columns, with the number of copies. One aggregate, so copies meet before
    the shuffle and not after, and ties give one row."""
    others = [c for c in rows.columns if c not in (signature, order)]
    return rows.groupBy(signature).agg(F.min(F.struct(order, *others)).alias("_row"), F.count("*").alias("copies")).select("_row.*", "copies")


def priority_lookup(groups: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """The groups with source and path of the first of sources (name, rows of key and path, path column) that holds the key."""
    out, found = groups, None
    for i, (name, rows, path) in enumerate(sources):
        one = rows.groupBy(key).agg(F.min(path).alias(f"_p{i}"), F.lit(name).alias(f"_s{i}"))
        out = out.join(one, key, "left")
        hit = F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("source"), F.col(f"_p{i}").alias("path")))
        found = hit if found is None else F.coalesce(found, hit)
    return out.select(*groups.columns, found["source"].alias("source_kind"), found["path"].alias("path"))


def prefilter(groups: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups still to do, and those left out with the reason: live where done has a path, else history."""
    one = done.groupBy(key).agg(F.max(F.col("path").isNotNull()).alias("_live"))
    left_out = groups.join(one, key).withColumn("reason", F.when(F.col("_live"), "live_note_index").otherwise("processed_history")).drop("_live")
    return groups.join(one, key, "left_anti"), left_out


def ingest_plan(files: DataFrame, ledger: DataFrame, present: DataFrame) -> DataFrame:
    """(name, digest) of files to process, upgrade or skip: a file is new or changed, has a record without a digest, or is as it was."""
    state = files.join(ledger.select("name", F.col("digest").alias("_old")), "name", "left").join(present.select("name", F.lit(True).alias("_there")), "name", "left")
    there = F.coalesce("_there", F.lit(False))
    action = F.when(~there | F.col("_old").isNull(), "process").when(F.col("_old") == "", "upgrade").when(F.col("_old") != F.col("digest"), "process").otherwise("skip")
    return state.select("name", "digest", action.alias("action"))


def ledger_audit(notes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(value, state): valid in both, orphan only in notes, ghost only in the ledger."""
    n = notes.select("value").distinct().withColumn("_n", F.lit(True))
    g = ledger.select("value").distinct().withColumn("_l", F.lit(True))
    return n.join(g, "value", "full").select("value", F.when(F.col("_n") & F.col("_l"), "valid").when(F.col("_n"), "orphan").otherwise("ghost").alias("state"))


def alias_rewrite(ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, seq): ledger lines with aliases (old, new) replaced, each value once at its first place."""
    mapped = ledger.join(aliases, ledger.value == aliases.old, "left").select(F.coalesce("new", "value").alias("value"), "seq")
    return mapped.groupBy("value").agg(F.min("seq").alias("seq"))
