"""Ordered rules as one when chain each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document types that take the larger model.
LARGE_TYPES = ("textbook", "phd-dissertation", "review", "perspective", "commentary")


def route(primary_pages: Column, total_pages: Column, kind: Column, review_like: Column, multichapter: Column | None = None, override: Column | None = None, small: str = "flash", large: str = "pro", primary_least: int = 30, total_least: int = 60) -> tuple[Column, Column]:
    """(model, reason): the first rule that holds decides."""
    rules = [
        (primary_pages >= primary_least, F.lit(f"primary_pdf_pages >= {primary_least}")),
        (total_pages >= total_least, F.lit(f"total_pdf_pages >= {total_least}")),
        (kind.isin(*LARGE_TYPES), F.concat(F.lit("document_type="), kind)),
        (review_like, F.lit("is_review_like=true")),
        (F.lit(False) if multichapter is None else multichapter, F.lit("is_multichapter_thesis=true")),
    ]
    reason = F.lit("default flash route")
    for holds, why in reversed(rules):
        reason = F.when(holds, why).otherwise(reason)
    model = F.when(reason == "default flash route", small).otherwise(large)
    if override is None:
        return model, reason
    given = F.coalesce(override, F.lit("")) != ""
    return F.when(given, override).otherwise(model), F.when(given, "manual override (--model)").otherwise(reason)


def fallback(high: Column, medium: Column, low: Column, template: Column, domain: Column, scope: Column, signal: Column) -> Column:
    """Why a note's tags need another pass, null if they don't. The reasons' texts are fixed values."""
    total, better = high + medium + low, high + medium
    return (
        F.when(total == 0, "candidate tags empty after deterministic prefill")
        .when((better == 0) & (total <= 1), "candidate tags remain very sparse after deterministic prefill")
        .when(template == "generic-research-note", "generic fallback template may need semantic candidate supplementation")
        .when(domain == "other", "research_domain=other triggers edge-theme fallback")
        .when(scope.isin("other", "needs-body-evidence"), F.concat(F.lit("scope_hint="), scope, F.lit(" triggers fallback review")))
        .when((signal == "weak") & (better == 0), "signal_quality=weak with no high/medium candidates")
    )


def split_parts(size: Column, pages: Column, most_bytes: int, most_pages: int) -> Column:
    """Parts a file is split into at first."""
    return F.greatest(F.lit(1), F.ceil(size / most_bytes), F.ceil(pages / most_pages)).cast("long")


def planned_parts(files: DataFrame, file: str, most_bytes: int, most_pages: int) -> DataFrame:
    """(file, part_index, page_start, page_end, bytes, reason) of files (file, pages: the bytes of each page in order): the parts that a file is split into.

    The first plan gives each part the same number of pages; a part that is still above most_bytes halves its span until it fits, and the next part begins where it ends with the
    planned span again. A file within both limits is one part. A file with a page above most_bytes has one row: that page, reason oversize_pdf and no parts; one without pages
    has reason corrupt_pdf. A file's pages are its own row, so its parts are found by a table function beside it, without a shuffle.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="part_index int, page_start int, page_end int, bytes long, reason string")
    class Halved:
        def eval(self, pages):
            if not pages:
                yield 0, None, None, None, "corrupt_pdf"
                return
            upto = [0]
            for n in pages:
                upto.append(upto[-1] + (n or 0))
            total, start, parts = len(pages), 0, []
            planned = max(1, -(-upto[-1] // most_bytes), -(-total // most_pages))
            span = max(1, min(most_pages, -(-total // planned)))
            while start < total:
                own = min(span, total - start)
                while upto[start + own] - upto[start] > most_bytes:
                    if own == 1:
                        yield 0, start + 1, start + 1, upto[start + 1] - upto[start], "oversize_pdf"
                        return
                    own //= 2
                parts.append((len(parts), start + 1, start + own, upto[start + own] - upto[start], None))
                start += own
            yield from parts

    spark = files.sparkSession
    spark.udtf.register("halved_parts", Halved)
    files.select(F.col(file), F.col("pages")).createOrReplaceTempView("_planned_files")
    return spark.sql(f"select f.{file}, h.* from _planned_files f, lateral halved_parts(f.pages) h")
