"""URL rules and block lists: a blocked Bloom filter passes possible hits to an exact hash join.

DataFrame functions only. A list entry is a host with all its subdomains and the start of a path. For
each url the keys (host suffix, path start) that could be listed are tried against the filter; those that
pass are joined with the list itself, so the filter's false positives change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, counted_join, hot_join

#: Largest filter that is broadcast, in 256-bit blocks (32 MB); a larger one is joined by a shuffle on the block.
MAX_BLOCKS = 1 << 20


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end); both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substr(rest, length(raw_host) + 1)"), r"^[^?#]*", 0)
    lowered = F.translate("raw_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("rest", rest).withColumn("raw_host", host.substr(F.lit(1), F.length(host))).withColumn("path", path).withColumn("host", lowered).drop("rest", "raw_host")


def _bits(key: Column) -> list[Column]:
    """Four masks of one 64-bit word each, with one bit set in each: the key's bits in its block."""
    return [F.expr(f"shiftleft(1L, cast(pmod(shiftright(h, {6 * k + 20}), 64) as int))").alias(f"m{k}") for k in range(4)]


def blocked_bloom(entries: DataFrame, key: str = "key", bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3) and the number of blocks. A key's block is its hash modulo that number; four of its 256 bits are set."""
    number = max(1, -(-entries.count() * bits_a_key // 256))
    hashed = entries.select(F.xxhash64(key).alias("h")).select(F.expr(f"pmod(h, {number}L)").alias("block"), *_bits(F.col("h")))
    return hashed.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)]), number


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of each page. rules: (host, path, verdict), one row for each (host, path).

    rule is the longest fitting entry (host || path; null: none fits) and verdict its verdict, else allow.
    Ids may repeat; pages with a null url have an empty host and fit nothing. An empty list allows all.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict")
    # Few lengths of paths occur in a list, whatever its size: at most the longest path's.
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    filled, number = blocked_bloom(listed)
    urls = with_host_path(pages.select(id_column, "url")).drop("url")
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    tried = distinct.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts)).select("host", "path", F.concat("suffix", "start").alias("key"), F.length("suffix").alias("host_length"))
    tried = tried.withColumn("h", F.xxhash64("key")).withColumn("block", F.expr(f"pmod(h, {number}L)"))
    passing = tried.join(F.broadcast(filled), "block") if number <= MAX_BLOCKS else counted_join(tried, filled, "block")
    for k, mask in enumerate(_bits(F.col("h"))):
        passing = passing.where(F.col(f"w{k}").bitwiseAND(mask) != 0)
    # a short entry (a whole top-level domain) is met by a large part of all addresses
    entry = F.struct("key", "host_length").alias("entry")
    fits = counted_join(passing.select("host", "path", entry), listed.select(entry, "verdict"), "entry")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("entry.key").alias("n"), F.col("entry.key").alias("key"), F.col("verdict"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(id_column, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def mirror_list(pages: DataFrame) -> DataFrame:
    """A block list that grows with the crawl: the addresses of pages whose body another address, smaller by code point, serves too.

    (host, path, verdict); empty hosts and bodies are left out. A body that very many addresses serve, such as an error page, is joined by broadcast.
    """
    served = with_host_path(pages.select("url", "html")).where("host <> '' and html <> ''").select("host", "path", F.xxhash64("html").alias("a"), F.sha2("html", 256).alias("body")).groupBy("body", "host", "path").count()
    served = checkpoint(served.select("body", "host", "path"))
    least = served.groupBy("body").agg(F.min(F.concat("host", "path")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return hot_join(served, least, "body", F.col("n"), served.count()).where(F.concat("host", "path") != F.col("least")).select("host", "path").distinct().withColumn("verdict", F.lit("block"))


def block_listed(judged: DataFrame, listed: DataFrame) -> DataFrame:
    """Verdict block where no rule fits and the list holds (host, path) itself, tried by the blocked filter first and then exactly.

    A list that grows with the crawl makes a filter that does so too: beyond MAX_BLOCKS it is joined by a shuffle on the block.
    """
    names = judged.columns
    entries = listed.select("host", "path").distinct().withColumn("key", F.concat("host", "path"))
    filled, number = blocked_bloom(entries)
    asked = judged.where("rule is null").select("host", "path").distinct().withColumn("h", F.xxhash64(F.concat("host", "path"))).withColumn("block", F.expr(f"pmod(h, {number}L)"))
    passing = asked.join(F.broadcast(filled), "block") if number <= MAX_BLOCKS else counted_join(asked, filled, "block")
    for k, mask in enumerate(_bits(F.col("h"))):
        passing = passing.where(F.col(f"w{k}").bitwiseAND(mask) != 0)
    hits = passing.select("host", "path").join(entries, ["host", "path"], "left_semi").withColumn("hit", F.lit(True))
    return judged.join(hits, ["host", "path"], "left").withColumn("verdict", F.when(F.col("rule").isNull() & F.col("hit"), "block").otherwise(F.col("verdict"))).select(names)
