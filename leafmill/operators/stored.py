"""Chunks stored by document, and retrieval that moves neither their texts nor any vector.

The table is bucketed and sorted by document, so questions come to the chunks of their document: questions are shuffled,
chunks are not.  Words and vectors are made where the two meet and last for a batch: a vector is 1.5 KB that hardly compresses,
many times its chunk's text, so neither the shuffle that stores chunks nor the table holds any.  What goes on from there is a score and the names of
question and chunk; texts are read again for the winners only, from the same buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions.text import words
from leafmill.operators.embed import encoder, similarities
from leafmill.operators.retrieve import lexical_score, number_bonus, number_words, top_k

_NARROW = ("question_id", "doc_id", "chunk_id", "chunk_idx", "page_number", "score")


class StoredChunks:
    """A table (doc_id, chunk_id, chunk_idx, page_number, text) in ``buckets`` buckets of documents."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        """path: where the table is stored, the session's warehouse if not given; buckets: as many as shuffle partitions if not given."""
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, chunks: DataFrame) -> None:
        """Store chunks (doc_id, chunk_id, chunk_idx, page_number, text)."""
        rows = chunks.select("doc_id", "chunk_id", "chunk_idx", "page_number", "text")
        # partitions are the buckets, so one task writes a bucket as one file
        writer = rows.repartition(self.buckets, "doc_id").write.format("parquet").mode("append").bucketBy(self.buckets, "doc_id").sortBy("doc_id")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def scored(self, questions: DataFrame) -> DataFrame:
        """(question_id, doc_id, question) to a score for each chunk of the document, without texts."""
        q = questions.select("question_id", F.col("doc_id").alias("_doc"), words(F.coalesce("question", F.lit(""))).alias("asked"))
        # what is the same for all chunks of a question is made below the join
        q = q.withColumn("_asked", F.array_distinct("asked")).withColumn("_numbers", number_words(F.col("_asked")))
        both = q.hint("merge").join(self.read(), F.col("_doc") == F.col("doc_id")).withColumn("said", words(F.coalesce("text", F.lit(""))))
        both = both.select(*_NARROW[:-1], lexical_score(F.col("_asked"), F.col("said")).alias("lexical"), number_bonus(F.col("_numbers"), F.col("text")).alias("bonus"), "asked", "said")
        kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in (*_NARROW[:-1], "lexical", "bonus")) + ", dense double"
        out = both.mapInArrow(_dense, kinds)
        share = F.greatest(F.lit(0.0), (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dense"))) + 1) / 2)
        score = F.lit(fixed.LEXICAL_SHARE) * F.col("lexical") + F.col("bonus") + F.lit(fixed.DENSE_SHARE) * share
        return out.select(*_NARROW[:-1], F.round(score, 4).alias("score"))

    def best(self, questions: DataFrame, k: int = 4) -> DataFrame:
        """The k best chunks of each question, with rank."""
        return top_k(self.scored(questions), k)

    def with_texts(self, top: DataFrame) -> DataFrame:
        """Ranked chunks with their texts, looked up in the buckets; an id that a document has twice gives each text once a rank."""
        texts = self.read().select(F.col("doc_id").alias("_doc"), F.col("chunk_id").alias("_chunk"), F.col("chunk_idx").alias("_idx"), "text")
        same = (F.col("doc_id") == F.col("_doc")) & (F.col("chunk_id") == F.col("_chunk")) & (F.col("chunk_idx") == F.col("_idx"))
        return top.hint("merge").join(texts, same).drop("_doc", "_chunk", "_idx")


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dot product of each row's question and chunk in place of their words."""
    for batch in batches:
        dense = similarities(encoder(), *batch.columns[-2:])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], dense], names=[*batch.schema.names[:-2], "dense"])
