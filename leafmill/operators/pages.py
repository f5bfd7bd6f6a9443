"""Post-processing of recognised words and the aggregates of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions.text import clean_text, repair_digits, strip


def clean_words(words: DataFrame) -> DataFrame:
    """Digits repaired, spaces cleaned, empty words gone, which are those that were blank before, too."""
    return words.where(strip(F.col("text")) != "").withColumn("text", clean_text(repair_digits(F.col("text"))))


def page_means(words: DataFrame) -> DataFrame:
    """doc_id, page_number, average_confidence and words of the pages that have any."""
    return words.groupBy("doc_id", "page_number").agg(F.round(F.avg("confidence"), 3).alias("average_confidence"), F.count(F.lit(1)).alias("words"))


def page_results(lines: DataFrame, words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, full_text (lines joined) and average_confidence (of words, 0 without any).

    Lines that clean to nothing are left out.  pages: all (doc_id, page_number), for pages without lines and words.
    """
    lines = lines.withColumn("text", clean_text(F.col("text"))).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line_number", F.col("text").alias("t"))))
    text = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("full_text"))
    both = text.join(page_means(words), ["doc_id", "page_number"], "full")
    if pages is not None:
        both = pages.select("doc_id", "page_number").distinct().join(both, ["doc_id", "page_number"], "left")
    return both.select("doc_id", "page_number", F.coalesce("full_text", F.lit("")).alias("full_text"), F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"), F.coalesce("words", F.lit(0)).alias("words"))


def document_results(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, total_words and overall_confidence: the mean of the pages' rounded means, not of words."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("words").alias("total_words"), F.round(F.avg("average_confidence"), 3).alias("overall_confidence"))


def document_text(pages: DataFrame, separator: str = fixed.PAGE_BREAK) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.when(F.col("full_text") != "", F.struct("page_number", "full_text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["full_text"]), separator).alias("full_text"))
