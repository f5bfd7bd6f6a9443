"""A stored index of JSON lines: what cannot be read is reported, and so is what is not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "doc_id bigint, chunk_id string, chunk_idx bigint, page_number int, text string"
META = "doc_id bigint, title string, chunk_count bigint"
SHOWN = 80


def write(chunks: DataFrame, meta: DataFrame, path: str) -> None:
    chunks.write.mode("append").json(f"{path}/chunks")
    meta.write.mode("append").json(f"{path}/meta")


def _read(spark: SparkSession, path: str, schema: str, whole_files: bool) -> DataFrame:
    """Rows with _broken (the text that is no record of the schema) and the file that they come from."""
    reader = spark.read.schema(f"{schema}, _broken string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", multiLine=whole_files)
    # the file's name is taken first, since a plan that asks for broken text alone is refused
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("path"))


def load(spark: SparkSession, path: str, schema: str = CHUNK, meta_schema: str = META, whole_files: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, rejects) of an index as ``write`` leaves it, or of whole-file JSON arrays.

    documents: doc_id, title, chunk_count and state: ``indexed``, ``untold`` (chunks without metadata, which are made up), or
    ``missing`` (metadata without a chunk that could be read).  rejects: path, part, reason, and the first characters of what was found there.
    """
    first = lambda s: s.split(",")[0].split()[0]
    parts = {"chunks": (schema, first(schema)), "meta": (meta_schema, first(meta_schema))}
    rows = {p: _read(spark, f"{path}/{p}", s, whole_files) for p, (s, _) in parts.items()}
    good = {p: rows[p].where(F.col("_broken").isNull() & F.col(k).isNotNull()).drop("_broken", "path") for p, (_, k) in parts.items()}
    rejects = None
    for p, (_, k) in parts.items():
        reason = F.when(F.col("_broken").isNotNull(), "no record").when(F.col(k).isNull(), f"no {k}")
        bad = rows[p].withColumn("reason", reason).where("reason is not null").select("path", F.lit(p).alias("part"), "reason", F.substring("_broken", 1, SHOWN).alias("found"))
        rejects = bad if rejects is None else rejects.unionByName(bad)
    counts = good["chunks"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    known = good["meta"].groupBy("doc_id").agg(F.max("title").alias("title"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_told").isNull(), "untold").otherwise("indexed")
    documents = counts.join(known.withColumn("_told", F.lit(True)), "doc_id", "full")
    documents = documents.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.coalesce("_n", F.lit(0)).alias("chunk_count"), state.alias("state"))
    return good["chunks"], documents, rejects
