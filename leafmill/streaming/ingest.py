"""Incremental ingest: a file stream of texts, chunked as in a batch, appended to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.chunk import paragraph_chunks


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def start_ingest(documents: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of new documents; each micro-batch is written once, under its own folder, and rewritten if it is retried."""

    def write(batch: DataFrame, number: int) -> None:
        paragraph_chunks(batch).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
