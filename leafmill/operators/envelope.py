"""The whole result of a document in one nested row, and its JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,width:int,height:int>"
#: What each input brings: its page, its order, and its columns.
_PARTS = {
    "own": ("page_number", None, "struct<full_text:string,average_confidence:double,words:bigint>"),
    "line": ("page_number", "line_number", f"struct<text:string,confidence:double,bbox:{BOX}>"),
    "table": ("page_number", "table_idx", "struct<rows:array<array<string>>>"),
    "field": (None, "place", "struct<field:string,field_name:string,value:string,confidence:double,page_number:int>"),
    "pair": (None, "position", "struct<key:string,value:string,confidence:double>"),
    "meta": (None, None, "struct<filename:string,page_count:int,processing_time_total_ms:double>"),
}


def _fields(kind: str) -> list[tuple[str, str]]:
    """Names and types in a struct type without nested commas at its top level but those between fields."""
    body, out, depth, start = kind[len("struct<") : -1], [], 0, 0
    for i, c in enumerate(body + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(tuple(body[start:i].split(":", 1)))
            start = i + 1
    return out


def _tagged(part: str, rows: DataFrame) -> DataFrame:
    """doc_id, page, place and one filled column of the six; a column that the input lacks is null."""
    page, place, kind = _PARTS[part]
    has = set(rows.columns)
    value = F.struct(*((F.col(n) if n in has else F.lit(None)).cast(t).alias(n) for n, t in _fields(kind)))
    others = [F.lit(None).cast(k).alias(p) if p != part else value.alias(p) for p, (_, _, k) in _PARTS.items()]
    at = lambda c: (F.col(c) if c and c in has else F.lit(None))
    return rows.select("doc_id", at(page).cast("int").alias("page"), at(place).cast("bigint").alias("place"), *others)


def _gathered(part: str) -> Column:
    """The part's rows of the group, in order."""
    listed = F.array_sort(F.collect_list(F.when(F.col(part).isNotNull(), F.struct("place", F.col(part).alias("v")))))
    return F.transform(listed, lambda s: s["v"])


def predictions(documents: DataFrame, pages: DataFrame, lines: DataFrame, tables: DataFrame, fields: DataFrame, key_values: DataFrame, model_name: str = "leafmill") -> DataFrame:
    """One row for each document: everything that is known of it, pages with their lines, tables, fields by name, key/values.

    documents: doc_id, filename, page_count and, if known, processing_time_total_ms.  pages: doc_id, page_number, full_text,
    average_confidence, words.  lines: doc_id, page_number, line_number, text, confidence, bbox.  tables: doc_id, page_number,
    table_idx, rows.  fields: doc_id, place, field, field_name, value, confidence, page_number.  key_values: doc_id, position,
    key, value, confidence.  Columns other than the keys may be missing.

    The six inputs are one union, dealt out by document once; pages are put together and then documents without
    moving rows again.  Rows of documents that ``documents`` does not have are left out, and documents without any rows are
    kept.  A page counts with its own row; lines and tables of a page without one are left out, as such pages are not results.
    """
    inputs = {"meta": documents, "own": pages, "line": lines, "table": tables, "field": fields, "pair": key_values}
    rows = reduce(DataFrame.unionByName, (_tagged(p, df) for p, df in inputs.items())).repartition("doc_id")
    by_page = rows.groupBy("doc_id", "page").agg(
        F.first("own", True).alias("own"), F.first("meta", True).alias("meta"), _gathered("line").alias("lines"), _gathered("table").alias("tables"), _gathered("field").alias("fields"), _gathered("pair").alias("pairs"),
    )
    page = F.when(F.col("own").isNotNull(), F.struct("page", "own", "lines", "tables"))
    of = lambda c: F.first(F.when(F.col("page").isNull(), F.col(c)), True).alias(c)
    docs = by_page.groupBy("doc_id").agg(of("meta"), of("fields"), of("pairs"), F.array_sort(F.collect_list(page)).alias("pages")).where("meta is not null")
    shown = F.transform("pages", lambda p: F.struct(p["page"].alias("page_number"), p["own"]["full_text"].alias("full_text"), F.size(p["lines"]).alias("line_count"), p["lines"].alias("lines")))
    tabled = F.flatten(F.transform("pages", lambda p: F.transform(p["tables"], lambda t: F.struct(p["page"].alias("page_number"), t["rows"].alias("rows")))))
    total = F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(p["own"]["words"], F.lit(0)))
    mean = F.aggregate("pages", F.lit(0.0), lambda n, p: n + F.coalesce(p["own"]["average_confidence"], F.lit(0.0))) / F.greatest(F.size("pages"), F.lit(1))
    # of fields with one name the first one counts
    named = F.filter("fields", lambda f, i: F.array_position(F.transform("fields", lambda g: g["field"]), f["field"]) == i + 1)
    return docs.select(
        F.lit("success").alias("status"), F.lit(model_name).alias("model_name"), "doc_id", "meta.filename", "meta.page_count",
        F.array_join(F.transform("pages", lambda p: F.coalesce(p["own"]["full_text"], F.lit(""))), "\n").alias("raw_text"), F.round(mean, 3).alias("overall_confidence"), total.alias("total_words"), "meta.processing_time_total_ms",
        F.map_from_entries(F.transform(named, lambda f: F.struct(f["field"], f.dropFields("field")))).alias("fields"), F.col("pairs").alias("key_values"), tabled.alias("tables"), shown.alias("pages"),
    )


def to_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select("doc_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def save(df: DataFrame, path: str) -> None:
    """A JSON line for each document."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)
