"""Context for chunks, made once: a stored table by the hashes of chunk, document, prompt and model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpoint
from .index import Buckets

KEYS = ("chunk_hash", "document_hash", "prompt_hash", "model_hash")


def store(spark: SparkSession, root: str, buckets: int = 64) -> Buckets:
    """The cache below root: (key, the four hashes, context), in hash buckets behind a pointer."""
    return Buckets(spark, root, f"key string, {', '.join(f'{k} string' for k in KEYS)}, context string", "key", "context-1", buckets)


def keyed(chunks: DataFrame, prompt: str, model: str) -> DataFrame:
    """chunks (with document_hash and chunk) with the four hashes and key, one for all of them."""
    own = chunks.withColumn("chunk_hash", F.sha2("chunk", 256)).withColumn("prompt_hash", F.sha2(F.lit(prompt), 256)).withColumn("model_hash", F.sha2(F.lit(model), 256))
    return own.withColumn("key", F.sha2(F.concat_ws("|", *[F.coalesce(k, F.lit("-")) for k in KEYS]), 256))


def with_context(chunks: DataFrame, cache: Buckets, prompt: str, model: str, make: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """chunks (document_hash, chunk and others) with context and hit, whether the cache had it.

    Only chunks that the cache lacks are made, each text of a document once: make() gets their rows (the columns of chunks and the keys) and adds context. What is made joins the cache
    as a version of the buckets it falls into, after all of it is there: a run that breaks off leaves the cache as it was. The chunk itself stays as it is, beside its context.
    A context that make() leaves null is not kept, so it is tried again.
    """
    rows = checkpoint(keyed(chunks, prompt, model))
    known = cache.rows()
    misses = rows.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    made = checkpoint(make(misses).where("context is not null").select("key", *KEYS, "context"))
    hits = known.select("key", "context", F.lit(True).alias("hit")).join(rows.select("key").distinct(), "key", "left_semi")
    out = checkpoint(rows.join(hits.unionByName(made.select("key", "context", F.lit(False).alias("hit"))), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    if made.limit(1).count():
        cache.replace(made, made.select("key"), version)
    return out.drop("key", *[k for k in KEYS if k not in chunks.columns])
