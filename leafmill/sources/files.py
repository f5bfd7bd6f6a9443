"""File sources with validation, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.sources.chunk_index import ChunkIndex


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def safe_name(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^a-zA-Z0-9_.-]", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("document"))


def detected_type(header: Column) -> Column:
    """What the first bytes say: pdf, png, jpeg, tiff, bmp, webp, or null.  It never rejects a file."""
    found = F.lit(None).cast("string")
    for kind, first in reversed(fixed.SIGNATURES.items()):
        found = F.when(F.substring(header, 1, len(first)) == F.lit(first), kind.split("_")[0]).otherwise(found)
    return found


def validated(files: DataFrame, *more: str) -> DataFrame:
    """(path, length, header) with extension, safe name, detected type and the reason of a rejection (null if accepted); more: columns that are passed on."""
    ext = extension(F.col("path"))
    reason = F.when(~ext.isin(fixed.EXTENSIONS), "extension").when(F.col("length") > fixed.MAX_BYTES, "size").when(F.col("length") == 0, "empty")
    return files.select("path", "length", ext.alias("extension"), safe_name(F.col("path")).alias("name"), detected_type(F.col("header")).alias("detected_type"), reason.alias("rejected"), *more)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploads as (doc_id, path, length, header, content); the id is a digest of the path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.sha2("path", 256).alias("doc_id"), "path", "length", F.substring("content", 1, 16).alias("header"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; a file that is none keeps its origin and has the reason in ``rejected``, and no pixels."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    return images.withColumn("rejected", F.when(F.col("width") <= 0, "not an image"))


def decode_base64(text: Column) -> Column:
    """Bytes of a base64 text, with or without a data address in front."""
    return F.unbase64(F.regexp_replace(text, "^[^,]*,", ""))


def write_index(chunks: DataFrame, path: str, replace: bool) -> None:
    """Add chunks to an index, or put them in place of what their documents had; see ChunkIndex."""
    index = ChunkIndex(chunks.sparkSession, path, chunks.schema.toDDL())
    index.replace(chunks) if replace else index.append(chunks)


def load_index(spark: SparkSession, path: str, meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and metadata (doc_id, title, chunk_count) of a stored index.

    meta: doc_id and title of the documents that have some; the title of the others is the one that the index keeps, or their id.
    """
    index = ChunkIndex(spark, path, None)
    listed = index.documents().select("doc_id", "title", "chunk_count")
    if meta is not None:
        known = meta.groupBy("doc_id").agg(F.max("title").alias("_title"))
        listed = listed.join(known, "doc_id", "left").select("doc_id", F.coalesce("_title", "title").alias("title"), "chunk_count")
    return index.chunks(), listed


def with_status(documents: DataFrame, events: DataFrame) -> DataFrame:
    """documents (doc_id, status, ...) with the latest status of their events (doc_id, at, status), if they have any."""
    latest = events.groupBy("doc_id").agg(F.max_by("status", "at").alias("_latest"))
    return documents.join(latest, "doc_id", "left").withColumn("status", F.coalesce("_latest", "status")).drop("_latest")


def without_document(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("doc_id"), "doc_id", "left_anti")


def document_details(documents: DataFrame, results: DataFrame, extracted: DataFrame) -> DataFrame:
    """Metadata with what is known of recognition and extraction."""
    return documents.join(results, "doc_id", "left").join(extracted, "doc_id", "left")


def export(rows: DataFrame, path: str, fmt: str) -> None:
    if fmt not in ("json", "csv"):
        raise ValueError(f"unsupported format {fmt!r}: json or csv")
    rows.write.option("header", True).mode("overwrite").format(fmt).save(path)
