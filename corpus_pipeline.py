"""The corpus pipeline: each stage reads what its predecessor wrote and returns the columns of documents, the last those of the mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, language, mixing, pii, simhash
from folioforge.llm.common import shared_folder, table

#: What the last stage adds, and what the mix works with.
ADDED = (*mixing.RESULTS, "copy")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with lang predicted; und goes: null texts and those without a letter."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    return language.label(docs, model).where("lang <> 'und'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash links stays, that of the smallest doc_id; rows without an id come last, and ids that repeat are told apart by their rows."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes [KIND]; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes: copy is 1 up to copies; documents with none go. A column of docs that has the name of one of ADDED, in any case, becomes own_<name>."""
    names = {c: f"own_{c}" if c.lower() in ADDED else c for c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(names)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names.values(), *(c for c in ADDED if c not in ("rate", "taken")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: The stages use models and hashes that SQL can't express; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet in the session's shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
