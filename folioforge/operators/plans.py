"""The plan of an analysis: one record of twenty fields for each group of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import route

#: The fields of a record, in order.
FIELDS = (
    "timestamp", "pdf_paths", "prepared_pdf_paths", "primary_pdf_pages", "total_pdf_pages", "pdf_page_counts", "primary_pdf_size_bytes", "total_pdf_size_bytes", "pdf_file_sizes_bytes", "profiler_model", "profiler_reason",
    "note_generator_model", "note_generator_reason", "manual_model_override", "flash_model_override", "pro_model_override", "chunking_enabled", "chunking_note", "prepared_pdf_manifest", "policy_version",
)


def model_plans(files: DataFrame, parts: DataFrame, profiles: DataFrame, at: Column, policy_version: str = "unknown", chunking_note: str = "", flash: str = "flash", pro: str = "pro", flash_override: str | None = None, pro_override: str | None = None, override: str | None = None) -> DataFrame:
    """(grp, the twenty FIELDS) of files (grp, place, path, pages, size), their parts (grp, path, part_index, page_start, page_end, transformation) and profiles (grp, document_type, review_like, multichapter).

    The file of the smallest place is the primary one; lists follow places, and parts their files and numbers. A file without parts is prepared as it is; chunking is on if a part is anything but
    passed through. A group without a profile is routed by its pages alone. The files of a group are a handful.
    """
    listed = files.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("place", "path", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("size", F.lit(0)).cast("long").alias("size")))).alias("f"))
    prepared = files.select("grp", "place", "path").join(parts, ["grp", "path"], "left")
    name = F.when(F.col("part_index").isNull() | (F.col("transformation") == "passthrough"), F.col("path")).otherwise(F.concat("path", F.lit("#"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    entry = F.struct("place", F.coalesce("part_index", F.lit(0)).alias("part_index"), name.alias("prepared"), "path", "page_start", "page_end", "transformation")
    manifest = prepared.groupBy("grp").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    rows = listed.join(manifest, "grp").join(profiles, "grp", "left")
    of = lambda c: F.transform("f", lambda x: x[c])
    total = lambda c: F.aggregate(of(c), F.lit(0).cast("long"), lambda s, x: s + x)
    small, large = flash_override or flash, pro_override or pro
    rows = rows.withColumn("primary_pdf_pages", F.col("f")[0]["pages"].cast("long")).withColumn("total_pdf_pages", total("pages"))
    model, reason = route(F.col("primary_pdf_pages"), F.col("total_pdf_pages"), F.coalesce("document_type", F.lit("")), F.coalesce("review_like", F.lit(False)), F.coalesce("multichapter", F.lit(False)), F.lit(override) if override else None, small, large)
    known = F.filter("m", lambda x: x["transformation"].isNotNull())
    values = {
        "timestamp": at, "pdf_paths": of("path"), "prepared_pdf_paths": F.transform("m", lambda x: x["prepared"]), "pdf_page_counts": F.transform(of("pages"), lambda x: x.cast("long")), "primary_pdf_size_bytes": F.col("f")[0]["size"], "total_pdf_size_bytes": total("size"),
        "pdf_file_sizes_bytes": of("size"), "profiler_model": F.lit(small), "profiler_reason": F.lit("default profiler"), "note_generator_model": model, "note_generator_reason": reason, "manual_model_override": F.lit(override).cast("string"), "flash_model_override": F.lit(flash_override).cast("string"),
        "pro_model_override": F.lit(pro_override).cast("string"), "chunking_enabled": F.exists(known, lambda x: x["transformation"] != "passthrough"), "chunking_note": F.lit(chunking_note), "policy_version": F.lit(policy_version),
        "prepared_pdf_manifest": F.transform(known, lambda x: F.struct(x["path"].alias("source_pdf_path"), x["prepared"].alias("prepared_pdf_path"), x["part_index"].alias("part_index"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"), x["transformation"].alias("transformation"))),
    }
    return rows.select("grp", *[values.get(c, F.col(c)).alias(c) for c in FIELDS])
