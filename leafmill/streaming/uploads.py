"""Ingest of uploaded files: each file once, whatever is repeated, and what is refused is kept with its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.text import strip
from leafmill.operators.chunk import paragraph_chunks
from leafmill.sources.chunk_index import CHUNKS, ChunkIndex
from leafmill.sources.files import validated
from leafmill.sources.shared import children

REGISTRY = "doc_id string, name string, path string, length bigint, detected_type string, status string, batch bigint"
QUARANTINE = "path string, name string, length bigint, detected_type string, rejected string, batch bigint"


class Uploads:
    """Batches of files (path, length, content) below ``root``: a registry of documents, a quarantine, and the chunk index.

    A document is known by the digest of its bytes, so a file that comes again under any name changes nothing.  Batches have
    numbers; each writes folders of its own, looks at earlier batches only, and commits to the index under a key, so a
    batch that is run again, whole or after half of it was done, gives what it gave before.
    """

    def __init__(self, spark: SparkSession, root: str, read: Callable[[Column], Column] = lambda content: F.try_validate_utf8(content.cast("string"))):
        """read: the text of a file's bytes, null where it can't be read."""
        self.spark, self.root, self.read = spark, root.rstrip("/"), read
        self.index = ChunkIndex(spark, f"{self.root}/index", CHUNKS.replace("doc_id bigint", "doc_id string"))

    def _folders(self, part: str, before: int | None) -> list[str]:
        found = [(int(name.removeprefix("batch=")), name) for name, _ in children(self.spark, f"{self.root}/{part}") if name.startswith("batch=")]
        return [f"{self.root}/{part}/{name}" for n, name in sorted(found) if before is None or n < before]

    def _table(self, part: str, schema: str, before: int | None = None) -> DataFrame:
        paths = self._folders(part, before)
        return self.spark.read.option("basePath", f"{self.root}/{part}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def registry(self, before: int | None = None) -> DataFrame:
        """All documents (of the batches before one)."""
        return self._table("registry", REGISTRY, before)

    def quarantine(self) -> DataFrame:
        return self._table("quarantine", QUARANTINE)

    def ingest(self, files: DataFrame, number: int) -> None:
        """Take a batch of files: staged once, then judged, registered and indexed."""
        digest = files.select("path", F.coalesce("length", F.lit(0)).alias("length"), F.substring("content", 1, 16).alias("header"), F.sha2("content", 256).alias("doc_id"), self.read(F.col("content")).alias("text"))
        told = validated(digest, "doc_id", "text")
        reason = F.coalesce("rejected", F.when(F.col("text").isNull(), "unreadable").when(strip(F.col("text")) == "", "blank text"))
        staged = f"{self.root}/staged/batch={number}"
        told.select("path", "name", "length", "detected_type", "doc_id", "text", reason.alias("rejected")).write.mode("overwrite").parquet(staged)
        rows = self.spark.read.parquet(staged)
        rows.where("rejected is not null").select("path", "name", "length", "detected_type", "rejected").write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={number}")
        # of files with the same bytes the first path names the document; only digests and paths are moved
        firsts = rows.where("rejected is null").groupBy("doc_id").agg(F.min(F.struct("path", "name", "length", "detected_type")).alias("f"))
        new = firsts.join(self.registry(number).select("doc_id"), "doc_id", "left_anti").select("doc_id", "f.name", "f.path", "f.length", "f.detected_type", F.lit("completed").alias("status"))
        new.write.mode("overwrite").parquet(f"{self.root}/registry/batch={number}")
        mine = self.spark.read.parquet(f"{self.root}/registry/batch={number}")
        texts = rows.where("rejected is null").join(mine.select("doc_id", "path"), ["doc_id", "path"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])
        self.index.append(paragraph_chunks(texts), mine.select("doc_id", F.col("name").alias("title")), key=f"upload-{number}")

    def document(self, doc_id: str) -> DataFrame:
        """The registry's row of one document; the condition reaches the scan."""
        return self.registry().where(F.col("doc_id") == doc_id)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as they come."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def start_uploads(files: DataFrame, uploads: Uploads, checkpoint: str) -> StreamingQuery:
    return files.writeStream.foreachBatch(lambda batch, number: uploads.ingest(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
