"""Content hashes and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def note_id(name: Column) -> Column:
    return F.md5(name)


def chunk_id(group_hash: Column, digest: Column, index: Column) -> Column:
    return F.concat(F.lit("group_"), F.substring(group_hash, 1, 16), F.lit("_file_"), F.substring(digest, 1, 16), F.lit("_chunk_"), index.cast("string"))


def neighbour_ids(chunk: Column) -> tuple[Column, Column]:
    """Ids of the chunk before (null at index 0) and after; null for ids of another form."""
    stem, index = F.regexp_extract(chunk, r"^(.*_chunk_)[0-9]+$", 1), F.regexp_extract(chunk, r"_chunk_([0-9]+)$", 1)
    number = F.when(stem != "", index.cast("int"))
    return F.when(number > 0, F.concat(stem, (number - 1).cast("string"))), F.when(number.isNotNull(), F.concat(stem, (number + 1).cast("string")))


def combined_hashes(files: DataFrame, group: str, digest: str = "digest", path: str = "path") -> DataFrame:
    """(group, stable, legacy, variants): SHA-256 over a group's file hashes in the order of the hashes, and of the lower-cased paths.

    Paths that differ in case only count once. Groups are a paper's files, a handful of hashes each.
    """
    one = files.groupBy(group, F.lower(path).alias("_p")).agg(F.min(digest).alias("_h"))
    listed = one.groupBy(group).agg(F.array_sort(F.collect_list("_h")).alias("_by_hash"), F.array_sort(F.collect_list(F.struct("_p", "_h"))).alias("_by_path"))
    stable = F.sha2(F.array_join("_by_hash", ""), 256)
    legacy = F.sha2(F.array_join(F.transform("_by_path", lambda x: x["_h"]), ""), 256)
    return listed.select(group, stable.alias("stable"), legacy.alias("legacy"), F.size(F.array_distinct(F.array(stable, legacy))).alias("variants"))
