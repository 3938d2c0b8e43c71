"""Exact duplicates: a first pass over hashes fills a blocked Bloom filter of those that may repeat, a second asks it; only rows that it names are shuffled.

DataFrame functions only. Texts are read once and never shuffled by duplicates(): what goes on is a digest of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_join

#: Fixed value: white space, each stretch of which counts as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Largest filter that is broadcast, in 256-bit blocks (32 MB); a larger one is met by a shuffle of digests on the block.
MAX_BLOCKS = 1 << 20
WORDS = ("w0", "w1", "w2", "w3")


def text_digest(text: str = "text") -> Column:
    """SHA-256 (lowercase hexadecimal digits) of the text with each stretch of white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def with_cells(rows: DataFrame, number: int, key: str = "digest") -> DataFrame:
    """rows with block, b1 and b2: the key's block among `number`, and its two bits of 256 there, which differ."""
    hashed = rows.withColumn("h", F.xxhash64(key)).withColumn("block", F.expr(f"pmod(h, {number}L)")).withColumn("b1", F.expr("cast(shiftrightunsigned(h, 20) & 255 as int)"))
    return hashed.withColumn("b2", F.expr("cast(pmod(b1 + 1 + pmod(shiftrightunsigned(h, 30), 255), 256) as int)")).drop("h")


def repeated_filter(rows: DataFrame, key: str = "digest", bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3, n) and the number of blocks: bits that two rows or more set. n counts the rows' bits there.

    The bits of a block are counted before they are shuffled, so a key that very many rows share is a row for each task.
    """
    number = max(1, -(-rows.count() * bits_a_key // 256))
    cells = with_cells(rows.select(key), number, key).select("block", F.explode(F.array("b1", "b2")).alias("bit")).groupBy("block", "bit").count().where("count > 1")
    word = lambda k: F.bit_or(F.expr(f"case when shiftright(bit, 6) = {k} then shiftleft(1L, bit & 63) else 0L end")).alias(f"w{k}")
    return cells.groupBy("block").agg(*[word(k) for k in range(4)], F.sum("count").alias("n")), number


def may_repeat(rows: DataFrame, filled: DataFrame, number: int, key: str = "digest") -> DataFrame:
    """rows with maybe: false only if the key is on one row. filled, number: repeated_filter() over these rows' keys."""
    asked = with_cells(rows, number, key)
    if number <= MAX_BLOCKS:
        met = asked.join(F.broadcast(filled), "block", "left")
    else:  # blocks of very many rows are broadcast, the others shuffled
        full = F.col("n") > max(8, 2 * rows.count() // 10_000)
        met = asked.join(F.broadcast(filled.where(full)), "block", "left")
        met = met.where("n is not null").unionByName(met.where("n is null").drop(*WORDS, "n").join(filled.where(~full), "block", "left"))
    bit = lambda b: F.expr(f"shiftright(case shiftright({b}, 6) when 0 then w0 when 1 then w1 when 2 then w2 else w3 end, {b} & 63) & 1")
    return met.withColumn("maybe", F.coalesce((bit("b1") == 1) & (bit("b2") == 1), F.lit(False))).drop("block", "b1", "b2", *WORDS, "n")


def duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of documents.

    Texts are equal if they are once each stretch of white space is one space; null counts as empty. Of equal texts the row of the smallest id stays, null last; of rows
    that repeat that id too, one. An empty table gives none, other columns are left out. A text that very many rows share is counted where it is read,
    and its count is broadcast.
    """
    rows = checkpoint(documents.select(F.col(id_column).alias("doc_id"), text_digest(text).alias("digest"))).withColumn("row", F.monotonically_increasing_id())
    rows = checkpoint(rows)  # a row's number holds when a task runs again
    asked = may_repeat(rows, *repeated_filter(rows))
    maybe = checkpoint(asked.where("maybe").drop("maybe"))
    groups = maybe.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row")).alias("least"), F.count("*").alias("group_size"))
    told = hot_join(maybe, groups, "digest", F.col("group_size"), maybe.count())
    met = told.select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"), F.col("digest").alias("text_sha256"))
    alone = asked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    return alone.unionByName(met)


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each text as duplicates() judges it; of rows that repeat the least id, that of the least content.

    Rows whose text can't repeat go straight through. Of the others each task sends one row of a text at most.
    """
    rows = documents.select(F.struct(*documents.columns).alias("row"), text_digest(text).alias("digest"))
    asked = may_repeat(rows, *repeated_filter(checkpoint(rows.select("digest"))))
    order = F.struct(F.col(f"row.{id_column}").isNull(), f"row.{id_column}", F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256))
    least = asked.where("maybe").groupBy("digest").agg(F.min_by("row", order).alias("row"))
    return asked.where("not maybe").select("row.*").unionByName(least.select("row.*"))
