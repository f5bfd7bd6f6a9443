"""The chunk index as a log of commits over files that never change.

A commit adds two folders and then one small file in ``log``, which alone makes them visible:

  * ``chunks/batch=<id>``: the chunks that it brings, sorted by document;
  * ``documents/batch=<id>``: a row for each document that it touches, with title and number of chunks, and whether the
    commit stands in place of what was known of the document (replace, delete) or adds to it (append).

A snapshot is what the commits up to a version say: chunks of a document from the last commit on that stands in place of
earlier ones (merge on read; the join is with the touched documents, not with all).  Readers hold a list of folders, so a
writer that works or fails meanwhile changes nothing for them.  ``compact`` writes a snapshot anew as one commit, in
the order of documents, so commits between its base and itself still apply on top.  A commit may carry a key: a second one of that
key does nothing, so a repeated batch of a stream counts once.

The list of documents (title, count, first and last time of indexing) is kept in the same way, from the commits'
own rows, and never counts chunks again.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.shared import children, created, removed

CHUNKS = "doc_id bigint, chunk_id string, chunk_idx bigint, page_number int, text string"
_LOG = "version bigint, kind string, batch string, base bigint, at timestamp, key string"
#: Bytes of a row group of chunks; footers and Bloom filters lead to the few groups that hold a document.
ROW_GROUP = 8 << 20


class ChunkIndex:
    """schema: the columns of chunks; doc_id is one of them, of any type.  None: those that the index has."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = CHUNKS, row_group: int = ROW_GROUP):
        self.spark, self.path, self.row_group = spark, path.rstrip("/"), row_group
        if schema is None:
            batch = next((r["batch"] for r in self.commits() if children(spark, f"{self.path}/chunks/batch={r['batch']}")), None)
            schema = spark.read.parquet(f"{self.path}/chunks/batch={batch}").schema.toDDL() if batch else CHUNKS
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        self.order = [c for c in ("doc_id", "chunk_idx") if c in self.columns]
        key = self.empty.schema["doc_id"].dataType.simpleString()
        self.schemas = {"chunks": f"{schema}, batch string", "documents": f"doc_id {key}, title string, chunk_count bigint, replaces boolean, first_indexed_at timestamp, indexed_at timestamp, batch string"}

    # commits

    def commits(self, version: int | None = None) -> list[Row]:
        """All commits up to a version, in order."""
        if not children(self.spark, f"{self.path}/log"):
            return []
        log = self.spark.read.schema(_LOG).json(f"{self.path}/log")
        return [r for r in log.orderBy("version").collect() if version is None or r["version"] <= version]

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        return max((r["version"] for r in self.commits()), default=0)

    def _live(self, version: int | None = None) -> list[tuple[str, int, datetime]]:
        """Batch, version and time of the commits that a snapshot consists of: the last compaction and what came after its base."""
        found = self.commits(version)
        packed = max((r for r in found if r["kind"] == "compact"), key=lambda r: r["base"], default=None)
        if packed is None:
            return [(r["batch"], r["version"], r["at"]) for r in found]
        later = [(r["batch"], r["version"], r["at"]) for r in found if r["kind"] != "compact" and r["version"] > packed["base"]]
        return [(packed["batch"], packed["base"], packed["at"]), *later]

    def _commit(self, kind: str, batch: str, key: str | None, base: int | None = None) -> int | None:
        at = datetime.now(UTC).isoformat()
        while True:
            known = self.commits()
            if key is not None and any(r["key"] == key for r in known):
                return None
            version = max((r["version"] for r in known), default=0) + 1
            entry = {"version": version, "kind": kind, "batch": batch, "base": base, "at": at, "key": key}
            if created(self.spark, f"{self.path}/log/{version:020d}.json", json.dumps(entry)):
                return version

    # writing

    def append(self, chunks: DataFrame, titles: DataFrame | None = None, key: str | None = None) -> int | None:
        """Add chunks to what their documents have.  Returns the version, or None where the key is known already."""
        return self._write("append", chunks, titles, None, key)

    def replace(self, chunks: DataFrame, documents: DataFrame | None = None, titles: DataFrame | None = None, key: str | None = None) -> int | None:
        """Put chunks in place of all that their documents had; documents (doc_id): those that are replaced even without a chunk."""
        return self._write("replace", chunks, titles, documents, key)

    def delete(self, documents: DataFrame, key: str | None = None) -> DataFrame:
        """Take documents out; returns those (doc_id) that were there."""
        before = self.version()
        gone = documents.select("doc_id").distinct()
        self._write("delete", self.empty, None, gone, key)
        return self.documents(before).select("doc_id").join(gone, "doc_id", "left_semi")

    def _write(self, kind: str, chunks: DataFrame, titles: DataFrame | None, documents: DataFrame | None, key: str | None) -> int | None:
        if key is not None and any(r["key"] == key for r in self.commits()):
            return None
        batch = uuid.uuid4().hex
        if kind != "delete":
            self._save(chunks.select(*self.columns).sortWithinPartitions(*self.order), batch)
        brought = self._read("chunks", [(batch, 0, None)]) if kind != "delete" else self.empty
        touched = brought.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        if documents is not None:
            touched = touched.join(documents.select("doc_id").distinct(), "doc_id", "full").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        if titles is not None:
            touched = touched.join(titles.groupBy("doc_id").agg(F.max("title").alias("title")), "doc_id", "left")
        else:
            touched = touched.withColumn("title", F.lit(None).cast("string"))
        never = F.lit(None).cast("timestamp")
        rows = touched.select("doc_id", "title", "chunk_count", F.lit(kind != "append").alias("replaces"), never.alias("first_indexed_at"), never.alias("indexed_at"))
        rows.write.parquet(f"{self.path}/documents/batch={batch}")
        return self._commit(kind, batch, key)

    def _save(self, chunks: DataFrame, batch: str) -> None:
        options = {"parquet.block.size": self.row_group, "parquet.bloom.filter.enabled#doc_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        chunks.write.options(**options).parquet(f"{self.path}/chunks/batch={batch}")

    def compact(self) -> int | None:
        """Write the present snapshot as one commit, in the order of documents; earlier versions can still be read."""
        base = self.version()
        if not base:
            return None
        batch = uuid.uuid4().hex
        self._save(self.chunks(base).repartitionByRange("doc_id").sortWithinPartitions(*self.order), batch)
        listed = self.documents(base).withColumn("replaces", F.lit(False))
        listed.select("doc_id", "title", "chunk_count", "replaces", "first_indexed_at", "indexed_at").write.parquet(f"{self.path}/documents/batch={batch}")
        return self._commit("compact", batch, None, base)

    def vacuum(self, oldest: int, abandoned_hours: float = 24) -> list[str]:
        """Delete folders that no snapshot from version ``oldest`` on reads, and those of writers that never committed, if that long unchanged."""
        known = self.commits()
        needed = {b for v in range(oldest, self.version() + 1) for b, _, _ in self._live(v)}
        committed, limit = {r["batch"] for r in known}, (datetime.now(UTC).timestamp() - abandoned_hours * 3600) * 1000
        out = []
        for part in ("chunks", "documents"):
            for name, changed in children(self.spark, f"{self.path}/{part}"):
                batch = name.removeprefix("batch=")
                if batch not in needed and (batch in committed or changed < limit):
                    removed(self.spark, f"{self.path}/{part}/{name}")
                    out.append(f"{part}/{name}")
        return out

    # reading

    def _read(self, part: str, live: list[tuple[str, int, datetime | None]]) -> DataFrame:
        """Rows of the given commits with their version and at."""
        paths = [f"{self.path}/{part}/batch={b}" for b, _, _ in live]
        paths = [p for p in paths if children(self.spark, p)]
        reader = self.spark.read.schema(self.schemas[part])
        rows = reader.option("basePath", f"{self.path}/{part}").parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[part])
        # the list is in the driver's hands already: one entry for each commit since the last compaction
        return rows.join(F.broadcast(self.spark.createDataFrame(live, "batch string, version bigint, at timestamp")), "batch")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of a snapshot (the last one if no version is given)."""
        live = self._live(version)
        since = self._read("documents", live).where("replaces").groupBy("doc_id").agg(F.max("version").alias("since"))
        rows = self._read("chunks", live).join(since, "doc_id", "left")
        return rows.where("since is null or version >= since").select(*self.columns)

    def document(self, doc_id: object, version: int | None = None) -> DataFrame:
        """Chunks of one document: the condition reaches the scans, where footers and Bloom filters leave few row groups."""
        return self.chunks(version).where(F.col("doc_id") == F.lit(doc_id)).orderBy(*self.order)

    def lookup(self, documents: DataFrame, version: int | None = None) -> DataFrame:
        """Chunks of all the given documents (doc_id)."""
        return self.chunks(version).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")

    def documents(self, version: int | None = None) -> DataFrame:
        """doc_id, title (the id where none was given), chunk_count, first_indexed_at and indexed_at of a snapshot's documents."""
        rows = self._read("documents", self._live(version))
        since = rows.where("replaces").groupBy("doc_id").agg(F.max("version").alias("since"))
        kept = rows.join(since, "doc_id", "left").where("since is null or version >= since")
        listed = kept.groupBy("doc_id").agg(
            F.max_by(F.when(F.col("title").isNotNull(), F.col("title")), F.when(F.col("title").isNotNull(), F.col("version"))).alias("title"), F.sum("chunk_count").alias("chunk_count"),
            F.min(F.coalesce("first_indexed_at", "at")).alias("first_indexed_at"), F.max(F.coalesce("indexed_at", "at")).alias("indexed_at"),
        )
        return listed.where("chunk_count > 0").withColumn("title", F.coalesce("title", F.col("doc_id").cast("string")))
