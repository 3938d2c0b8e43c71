"""Chunks along a text's sections, and captions bound to the paragraph they stand next to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A heading is a line of one to six # and a title; a caption begins with one of these and a number.
HEADING = r"(#{1,6})\s+(.*\S)\s*"
CAPTION = r"(?i)(?:figure|fig\.|table|scheme|图|表)\s*\d+"


def _pieces(documents: DataFrame, id_column: str, text: str, target: int, most: int, bind: bool) -> DataFrame:
    """(id, kind, chunk_index, section_path, start, stop, chunk, paragraphs): chunks, and with bind also captions (kind caption, without an index). One pass over a text."""
    heading, caption = HEADING, CAPTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        is_heading, is_caption = re.compile(heading), re.compile(caption)

        def cut(t: str) -> list[tuple]:
            out, path, paragraphs, at, index = [], [], [], 0, 0

            def close():
                nonlocal paragraphs, index
                if paragraphs:
                    start, stop = paragraphs[0][0], paragraphs[-1][1]
                    out.append(("chunk", index, " > ".join(p[1] for p in path), start, stop, t[start:stop], paragraphs))
                    paragraphs, index = [], index + 1

            for line in t.split("\n"):
                start, stop = at, at + len(line)
                at = stop + 1
                if not line.strip():
                    continue
                if found := is_heading.fullmatch(line):
                    close()
                    path = [p for p in path if p[0] < len(found[1])] + [(len(found[1]), found[2])]
                elif bind and is_caption.match(line):
                    out.append(("caption", None, " > ".join(p[1] for p in path), start, stop, line, []))
                    continue
                if paragraphs and (paragraphs[-1][1] - paragraphs[0][0] >= target or stop - paragraphs[0][0] > most):
                    close()
                for a in range(start, stop, most):  # a paragraph beyond the hard size is cut
                    if a > start:
                        close()
                    paragraphs.append((a, min(stop, a + most)))
            close()
            return out

        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pair]
        names = ["id", "kind", "chunk_index", "section_path", "start", "stop", "chunk", "paragraphs"]
        for b in batches:
            row, cells = [], []
            for k, t in enumerate(b.column(1)):
                own = cut(t.as_py() or "")
                row += [k] * len(own)
                cells += own
            columns = zip(*cells, strict=True) if cells else [[]] * len(kinds)
            listed = [list(c) for c in columns]
            listed[6] = [[{"start": a, "stop": z} for a, z in x] for x in listed[6]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, kind) for c, kind in zip(listed, kinds, strict=True)]], names)

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, kind string, chunk_index int, section_path string, start long, stop long, chunk string, paragraphs array<struct<start:long,stop:long>>"
    return documents.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def section_chunks(documents: DataFrame, id_column: str = "doc_id", text: str = "text", target: int = 1200, most: int = 2000) -> DataFrame:
    """(id_column, chunk_index, section_path, start, stop, chunk): paragraphs (lines with something on them) packed within a section; chunk is the text from start to stop (code points).

    A heading closes the chunk before it, begins the next and names its path with the headings above it. A chunk takes paragraphs until it has target characters, and never more than
    most; a longer paragraph is cut. Null and empty texts give no chunks; rows of a repeated id are cut each by itself.
    """
    rows = _pieces(documents, id_column, text, target, most, bind=False)
    return rows.select(F.col("id").alias(id_column), "chunk_index", "section_path", "start", "stop", "chunk")


def bound_chunks(documents: DataFrame, id_column: str = "doc_id", text: str = "text", target: int = 1200, most: int = 2000) -> DataFrame:
    """section_chunks() without captions in them, and captions: those (start, caption) whose nearest paragraph the chunk holds, by start; the one before wins a tie. Chunks go on
    over a caption, so their texts may hold it, but no chunk begins or ends with one. Captions of a text without paragraphs are left out. Ids are unique.

    The nearest paragraph is found by positions: of the sorted paragraphs and captions of a text each caption looks at the last one before it and the first one after it.
    """
    rows = _pieces(documents, id_column, text, target, most, bind=True)
    body = rows.where("kind = 'chunk'").select("id", "chunk_index", F.explode("paragraphs").alias("p")).select("id", F.col("p.start").alias("at"), "chunk_index", "p", F.lit(None).cast("string").alias("caption"))
    notes = rows.where("kind = 'caption'").select("id", F.col("start").alias("at"), F.lit(None).cast("int").alias("chunk_index"), F.struct("start", "stop").alias("p"), F.col("chunk").alias("caption"))
    order = Window.partitionBy("id").orderBy("at")
    near = F.when(F.col("caption").isNull(), F.struct("p.start", "p.stop", "chunk_index"))
    placed = body.unionByName(notes).select("id", "at", "p", "caption", F.last(near, True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first(near, True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    to_before, to_behind = F.col("p.start") - F.col("before.stop"), F.col("behind.start") - F.col("p.stop")
    owner = F.when(F.col("behind").isNull() | (to_before <= to_behind), F.col("before.chunk_index")).otherwise(F.col("behind.chunk_index"))
    bound = placed.where("caption is not null").select("id", owner.alias("chunk_index"), F.struct(F.col("p.start").alias("start"), "caption").alias("c")).groupBy("id", "chunk_index").agg(F.array_sort(F.collect_list("c")).alias("captions"))
    chunks = rows.where("kind = 'chunk'").select("id", "chunk_index", "section_path", "start", "stop", "chunk")
    none = F.array().cast("array<struct<start:bigint,caption:string>>")
    return chunks.join(bound, ["id", "chunk_index"], "left").select(F.col("id").alias(id_column), "chunk_index", "section_path", "start", "stop", "chunk", F.coalesce("captions", none).alias("captions"))
