"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and sorted by its SHA-256
digest; it exists from the start, empty.  A new batch is reduced to its own distinct digests,
deduplicated against the index by a sort-merge anti-join on the digest, and what is new is appended.  The
join uses the buckets, so the index is not shuffled, where it has as many as the session has shuffle partitions,
which is the default; its buckets, one sorted file a batch, are sorted in the task that reads them.

``deduplicate`` moves digests only; they are computed once, in the scan, and written down.  ``kept_rows`` computes
them again to find the rows that stay, and moves rows with their texts once, by digest.  A text that fills a third of
all rows is pre-aggregated before the shuffle, and the join that brings the answer back to the rows is an
ordinary equi-join, which Spark splits where a digest is hot.

Edge cases: a null text counts as empty, and all empty texts are equal; of equal texts the row with the
smallest key stays, a null key comes last; ``deduplicate`` answers every row, and rows that repeat key and
text get the same answer; ``kept_rows`` keeps one of them (the first by its other columns); an empty table
gives no rows; further columns are ignored by ``deduplicate`` and passed on by ``kept_rows``, whatever
they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, shared_folder, table, unused, written

#: White space that counts as one space.
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by digest, that grows by batches."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None, key_type: str = "bigint"):
        """path: where the table is stored, the session's warehouse if not given; buckets: of a new index, its session's shuffle partitions if not given."""
        self.spark, self.name, self.path = spark, name, path
        if not spark.catalog.tableExists(name):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._save(spark.createDataFrame([], f"digest binary, keep_id {key_type}, batch string"))
        else:
            described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
            self.buckets = int(described["Num Buckets"])

    def _save(self, rows: DataFrame) -> None:
        # partitions are the buckets, so one task writes a bucket as one file
        writer = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` (digest, ...) that the index lacks, by a sort-merge anti-join."""
        return found.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, found: DataFrame, batch: str) -> None:
        """Add the digests of ``found`` (digest, keep_id) that the index lacks; a batch that is added again adds nothing."""
        self._save(self.new(found).select("digest", "keep_id", F.lit(batch).alias("batch")))

    def drop(self) -> None:
        """Remove the index and its rows."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            dropped(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append the batch to the index and say of every row which row of its text stays.

    Returns key, keep_id, group_size, kept and text_sha256, one row per input row.  keep_id comes
    from the index: the smallest key of the batch that brought the text first.  group_size counts
    the rows of this batch with the text.
    """
    rows = written(docs.select(F.col(key).alias("key"), digest_of(F.col(text)).alias("digest")), "digests")
    # written, so that the anti-join is not pushed below the aggregation
    groups = written(rows.groupBy("digest").agg(F.min("key").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    index.append(groups.select("digest", F.col("first_id").alias("keep_id")), batch)
    answers = groups.drop("first_id").hint("merge").join(index.read().select("digest", "keep_id"), "digest")
    out = rows.join(answers, "digest")
    return out.select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each text that is new to the index."""
    digest, keep = unused(docs, "_digest"), unused(docs, "_keep")
    rows = written(docs.select(F.col(key).alias("key"), digest_of(F.col(text)).alias("digest")), "digests")
    index.append(written(rows.groupBy("digest").agg(F.min("key").alias("keep_id")), "groups"), batch)
    mine = index.read().where(F.col("batch") == batch).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    marked = docs.withColumn(digest, digest_of(F.col(text)))
    stay = marked.join(mine, (marked[digest] == mine[digest]) & marked[key].eqNullSafe(mine[keep]), "left_semi")
    twins = written(rows.groupBy("digest", "key").count().where("count > 1").select(F.col("digest").alias(digest)).distinct(), "twins")
    if twins.isEmpty():
        return stay.drop(digest)
    # rows that repeat key and text: the window's limit leaves one of each before the shuffle
    rank = unused(docs, "_rank")
    order = Window.partitionBy(digest).orderBy(*(F.col(c) for c in docs.columns))
    one = stay.join(twins, digest, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return stay.join(twins, digest, "left_anti").unionByName(one).drop(digest)


def fresh_index(spark: SparkSession, label: str) -> DigestIndex:
    """An empty index in the shared folder, for a run that starts from nothing."""
    name = f"digest_index_{label}_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, f"{shared_folder(spark)}/{name}")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicate(docs, fresh_index(spark, "op7"), "documents")


ORACLE = """
WITH t AS (
  SELECT doc_id, lower(sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
