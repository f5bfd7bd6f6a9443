"""Corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  All stages but the last return the columns of documents; the last adds the
token ids, their number and the text that they decode to.

Edge cases, of all stages: a null or empty text has no letter and goes at the first stage; a very long text is a row like any
other; of rows that repeat a document one stays (exact copies); null ids, languages and sources are passed on; an
empty table gives no rows; further columns of the input are left out, so their names can't clash.  Stages apart from the first
one keep null and empty texts, the exact one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontamination, exact_dedup, language, near_dedup, pieces
from leafmill.llm.common import fold, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity of near copies in hundredths; op9's own query has another.
NEAR = 80
#: Bytes of an Arrow batch between Spark and Python, unless the session sets another number: texts go in whole, so rows alone don't bound a batch.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bound_batches(spark: SparkSession) -> None:
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language can be told; a text without a letter is rejected.  The model learns from the stage's own input.

    Where no row has a label there is nothing to learn, and only texts without a letter are rejected.
    """
    bound_batches(spark)
    model = language.fit(docs.where(fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    told = language.predict(docs.withColumn("_read", F.col("text")), model, "_read")
    return told.where(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, by a digest index that starts empty."""
    return exact_dedup.kept_rows(docs, exact_dedup.fresh_index(spark, "pipeline"), "documents").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, which are links of similarity NEAR."""
    bound_batches(spark)
    gone = near_dedup.near_duplicates(docs, threshold=NEAR).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    bound_batches(spark)
    return decontamination.kept_rows(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the decoded text."""
    bound_batches(spark)
    out = pieces.encode(docs.withColumn("_read", F.col("text")), pieces.default_model(), "_read")
    return out.select(*COLUMNS, "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [("language", languages), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", leaks), ("tokens", tokens)]

#: SQL can't express the stages; the pipeline is tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
