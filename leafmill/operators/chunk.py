"""Chunking: paragraphs, overlapping word windows, line windows, summaries and table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions.text import GAP, bound, strip, title_key


def paragraph_chunks(docs: DataFrame, page: int = 1) -> DataFrame:
    """(doc_id, text) to (doc_id, chunk_id, chunk_idx, page_number, text), in order.

    A paragraph of up to 300 characters is a chunk; a longer one gives windows of 40 words every 30 words.
    All inside the row, so no shuffle: an array of chunks is built and exploded with its position.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda p: p != "")

    def windows(w):
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(fixed.STEP_WORDS))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(fixed.WINDOW_WORDS)), " "))
        return F.filter(cut, lambda c: F.char_length(c) > fixed.LEAST_CHARS)

    chunks = F.flatten(F.transform(lines, lambda p: F.when(F.char_length(p) <= fixed.PARAGRAPH_CHARS, F.array(p)).otherwise(bound(F.split(p, GAP), windows))))
    out = docs.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(f"_p{page}_c"), F.col("chunk_idx").cast("string"))
    return out.select("doc_id", name.alias("chunk_id"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.lit(page).alias("page_number"), "text")


def line_windows(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_number, text) to windows of three lines every two lines: (doc_id, page_number, window, text, line_count).

    The lines of a page are gathered, a page being the unit; line_count is set on full windows only.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_number", strip(F.col("text")).alias("t"))))
    pages = lines.where(strip(F.col("text")) != "").groupBy("doc_id", "page_number").agg(F.transform(ordered, lambda s: s["t"]).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(2))
    made = pages.select("doc_id", "page_number", F.posexplode(F.transform(starts, lambda i: F.slice("all", i + 1, F.lit(3)))).alias("window", "part"))
    # a page that ends with a full window keeps its last line as a window of its own
    return made.select("doc_id", "page_number", "window", F.array_join("part", " ").alias("text"), F.when(F.size("part") == 3, F.lit(3)).alias("line_count"))


def summary_chunks(fields: DataFrame) -> DataFrame:
    """(doc_id, position, field, value) to a chunk for each document: a heading and a line for each field."""
    line = F.concat(title_key(F.col("field")), F.lit(": "), F.col("value"))
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    body = F.array_join(F.transform(parts, lambda s: s["line"]), "\n")
    out = fields.groupBy("doc_id").agg(F.concat(F.lit(fixed.SUMMARY_HEADING), body).alias("text"))
    return out.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_summary")).alias("chunk_id"), F.lit(1).alias("page_number"), "text")


def table_row_chunks(tables: DataFrame) -> DataFrame:
    """(doc_id, table_idx, rows) to a chunk for each row that has any text."""
    rows = tables.select("doc_id", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))
    text = F.array_join("cells", " | ")
    named = rows.where(strip(text) != "").select(
        "doc_id",
        F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("table_idx").cast("string")), F.concat(F.lit("r"), F.col("row_idx").cast("string"))).alias("chunk_id"),
        F.concat(F.lit("Table "), (F.col("table_idx") + 1).cast("string"), F.lit(" Row "), (F.col("row_idx") + 1).cast("string"), F.lit(": "), text).alias("text"),
    )
    return named


def ocr_chunks(lines: DataFrame, fields: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """All chunks of recognised documents: doc_id, chunk_id, chunk_idx, page_number, text, type, line_count and bbox.

    A summary of the fields comes first, then the rows of tables, then windows of lines, whose ids go on counting.
    lines: doc_id, page_number, line_number, text and, if there is one, bbox; a window has the box of its first line with one.
    fields: doc_id, position, field, value.  tables: doc_id, page_number, table_idx, rows.
    """
    box = "bbox" if "bbox" in lines.columns else None
    line = F.struct("line_number", strip(F.col("text")).alias("t"), *([box] if box else []))
    pages = lines.where(strip(F.col("text")) != "").groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(line)).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(2))
    windows = pages.select("doc_id", "page_number", F.posexplode(F.transform(starts, lambda i: F.slice("all", i + 1, F.lit(3)))).alias("place", "part"))
    boxes = F.get(F.filter(F.transform("part", lambda s: s[box]), lambda b: b.isNotNull()), F.lit(0)) if box else F.lit(None).cast("string")
    made = windows.select("doc_id", F.lit(2).alias("kind"), "page_number", "place", F.lit(None).cast("string").alias("chunk_id"), F.array_join(F.transform("part", lambda s: s["t"]), " ").alias("text"), F.lit("ocr_text").alias("type"), F.when(F.size("part") == 3, F.lit(3)).alias("line_count"), boxes.alias("bbox"))
    no_box = F.lit(None).cast(made.schema["bbox"].dataType).alias("bbox")
    if fields is not None:
        made = made.unionByName(summary_chunks(fields).select("doc_id", F.lit(0).alias("kind"), "page_number", F.lit(0).alias("place"), "chunk_id", "text", F.lit("structured_summary").alias("type"), F.lit(None).cast("int").alias("line_count"), no_box))
    if tables is not None:
        of_tables = tables.select("doc_id", F.col("table_idx").alias("t"), "page_number")
        rows = table_row_chunks(tables).withColumns({"t": F.regexp_extract("chunk_id", r"_t(\d+)_r\d+$", 1).cast("int"), "r": F.regexp_extract("chunk_id", r"_r(\d+)$", 1).cast("int")})
        rows = rows.join(of_tables, ["doc_id", "t"])
        made = made.unionByName(rows.select("doc_id", F.lit(1).alias("kind"), "page_number", (F.col("t").cast("bigint") * (1 << 31) + F.col("r")).alias("place"), "chunk_id", "text", F.lit("table_row").alias("type"), F.lit(None).cast("int").alias("line_count"), no_box))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", F.when(F.col("kind") == 2, F.col("page_number")), "place")) - 1
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_"), F.col("chunk_idx").cast("string"))
    out = made.withColumn("chunk_idx", index.cast("bigint"))
    return out.select("doc_id", F.coalesce("chunk_id", name).alias("chunk_id"), "chunk_idx", "page_number", "text", "type", "line_count", "bbox")


def document_meta(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, title (the id where none is known) and chunk_count of indexed documents."""
    stats = index_stats(chunks)
    title = F.col("doc_id").cast("string")
    if titles is None:
        return stats.select("doc_id", title.alias("title"), "chunk_count")
    return stats.join(titles.select("doc_id", "title"), "doc_id", "left").select("doc_id", F.coalesce("title", title).alias("title"), "chunk_count")


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with an ordinal that is unique in the document even where ids repeat after a page was ingested twice."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "text")) - 1)
