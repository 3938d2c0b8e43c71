"""Column expressions over text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings that begin the reference section, in any case. (?U) lets \s take Unicode spaces.
HEADING = r"(?iU)\n(?:References|Bibliography|参考文献|Acknowledgements)\s*\n"
#: Characters that a YAML scalar must be quoted for.
YAML_SPECIAL = r"""[:#{}\[\],&*?|<>=!%@`\\]"""


def chunk_rows(documents: DataFrame, text: str = "text", size: int = 800, step: int = 700, least: int = 100) -> DataFrame:
    """One row for each window of `size` characters every `step`, if longer than `least`: chunk_index, chunk_start, chunk. text is left out.

    Windows of a text only get shorter towards its end, so the kept ones are its first and the index is the window's own.
    """
    if size < 1 or step < 1 or least < 0:
        raise ValueError("size and step must be positive, least not negative")
    at = F.col(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(at) - 1, F.lit(0)), F.lit(step)), lambda s: F.least(F.length(at) - s, F.lit(size)) > least)
    rows = documents.select("*", F.posexplode(starts).alias("chunk_index", "chunk_start"))
    return rows.withColumn("chunk", F.substring(at, F.col("chunk_start") + 1, F.lit(size))).drop(text)


def packed_chunks(documents: DataFrame, text: str = "text", size: int = 800) -> DataFrame:
    """Whole paragraphs packed into chunks of at most `size` characters (a longer paragraph is a chunk of its own): chunk_index, chunk. Blank lines are left out; null and empty texts have none.

    Where a chunk ends depends on where the last one did, so a text is gone through once, in the task that read it; nothing is shuffled.
    """
    keys = [c for c in documents.columns if c != text]
    rows = documents.select(F.struct(F.lit(0).alias("_"), *keys).alias("own"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, index, chunk = [], [], []
            for k, t in enumerate(b.column(1)):
                held, chars, n = [], 0, 0
                for p in (t.as_py() or "").split("\n"):
                    if held and p and chars + 1 + len(p) > size:
                        row.append(k)
                        index.append(n)
                        chunk.append("\n".join(held))
                        held, chars, n = [], 0, n + 1
                    if p:
                        chars += len(p) + bool(held)
                        held.append(p)
                if held:
                    row.append(k)
                    index.append(n)
                    chunk.append("\n".join(held))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(chunk, pa.string())], ["own", "chunk_index", "chunk"])

    cut = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, chunk_index int, chunk string")
    return cut.select(*[F.col("own")[c].alias(c) for c in keys], "chunk_index", "chunk")


def without_references(text: Column) -> Column:
    """The text up to the last of the non-overlapping headings (the whole text without one)."""
    matches, parts = F.regexp_extract_all(text, F.lit(HEADING), 0), F.split(text, HEADING, -1)
    cut = F.length(text) - F.length(F.element_at(parts, -1)) - F.length(F.element_at(matches, -1))
    return F.when(F.size(matches) > 0, text.substr(F.lit(1), cut)).otherwise(text)


def joined_pages(pages: Column) -> Column:
    """Page texts in order, null as empty, joined by a line break."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "\n")


def language_hint(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text.rlike("[一-鿿]"), "zh").otherwise("en")


def slug(query: Column, most: int = 32) -> Column:
    """A short file-safe title of a query."""
    ends = lambda c: F.regexp_replace(c, r"^[-_. ]+|[-_. ]+$", "")
    clean = F.regexp_replace(F.trim(F.coalesce(query, F.lit(""))), r'[\\/:*?"<>|]+', "")
    clean = ends(F.regexp_replace(F.regexp_replace(clean, r"\s+", "-"), "-{2,}", "-"))
    short = F.regexp_replace(F.substring(clean, 1, most), r"[-_. ]+$", "")
    return F.when(short == "", "query").otherwise(short)


def session_title(snapshot: Column, query: Column, most: int = 120) -> Column:
    """The first line with anything on it, else the query, spaces collapsed, cut, without closing punctuation; else a literal."""
    lines = F.filter(F.split(F.coalesce(snapshot, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), query, F.lit(""))
    one = F.trim(F.regexp_replace(first, r"\s+", " "))
    return F.when(one == "", "Untitled session").otherwise(F.regexp_replace(F.substring(one, 1, most), r"[ .,;:]+$", ""))


def yaml_scalar(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.coalesce(value, F.lit("")) == "", "''").when(value.rlike("^[0-9]+$"), value).when(value.rlike(YAML_SPECIAL), quoted).otherwise(value)


def frontmatter(fields: list[tuple[str, Column]]) -> Column:
    """A block of `key: value` lines in the given order; arrays become lists, empty ones []."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_scalar(v)) for k, v in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def frontmatter_parts(content: Column) -> tuple[Column, Column]:
    """The block between the opening and the first closing --- line, and what follows; empty and the whole text without one."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n"
    found = F.regexp_extract(content, pattern, 0)
    return F.regexp_extract(content, pattern, 1), content.substr(F.length(found) + 1, F.length(content))


def frontmatter_value(block: Column, key: str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(block, rf"(?m)^{key}:\s*(.*)$", 1)), "^'(.*)'$", "$1")


def grounded(term: Column, anchor: Column) -> Column:
    """Letters and digits only: equal, or one of six or more holds within the other."""
    a, b = (F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "") for c in (term, anchor))
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 6) & b.contains(a)) | ((F.length(b) >= 6) & a.contains(b)))
