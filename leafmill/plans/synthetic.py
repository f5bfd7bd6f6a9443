"""Documents, boxes and logs made from the star schema, by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import spread

#: Amount in cents as text with two decimals.
_MONEY = "CAST(CAST(floor({c} / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0')"
_CENTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"
_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
#: The lines of an order's invoice.
INVOICE = [
    "CASE WHEN o_orderkey % 3 = 0 THEN '* Harbour Traders Pvt Ltd' WHEN o_orderkey % 3 = 1 THEN 'Hill Market' ELSE 'Delivery note' END",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'Bill Number' ELSE 'Invoice Number: INV-' || CAST(o_orderkey AS STRING) END",
    f"CASE WHEN o_orderkey % 4 = 0 THEN 'Date: ' || substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 1, 4) ELSE 'Date: ' || {_DAY} END",
    "'Customer Name: ' || replace(c_name, '#', ' ')",
    "'E-mail: c' || CAST(o_custkey AS STRING) || '@example.com'",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Mobile: 98765' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') ELSE 'Route - north' END",
    "'Bank Name: Coast Bank'",
    "'A/c No: ' || lpad(CAST(o_custkey AS STRING), 10, '4')",
    "'IFSC: ABCD0' || lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0')",
    f"CASE WHEN o_orderkey % 7 = 0 THEN 'Sub total $' || {_MONEY.format(c=_CENTS)} ELSE 'Priority = ' || o_orderpriority END",
    "'Tax: $' || CAST(o_orderkey % 90 AS STRING) || '.50'",
    f"CASE WHEN o_orderkey % 6 = 0 THEN 'Total' ELSE 'Total: $' || {_MONEY.format(c=_CENTS)} END",
    f"CASE WHEN o_orderkey % 6 = 0 THEN 'payable ' || {_MONEY.format(c=_CENTS)} WHEN o_orderkey % 6 = 1 THEN 'Bal. of account 12.5' ELSE 'Balance due later' END",
]
QUESTIONS = ["What is the total amount payable?", "When was it issued, on which date?", "Which invoice number is this?", "Who is the vendor?", "Give an overview, please", "Tell me more of Coast"]
_ASKED = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(QUESTIONS)) + " END"
#: Words of a line item on its order's page: (text, x, width); y follows from the line.
WORDS = [("'P' || CAST(l_partkey AS STRING)", 20, 90), ("'Qty:'", 130, 40), ("CAST(CAST(l_quantity AS BIGINT) AS STRING)", 190, 30), ("l_returnflag || l_linestatus", 260, 25)]
Y = "(l_linenumber * 40 + l_suppkey % 5)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, line_number, text: thirteen lines an order, the last four on page 2."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    both = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    lines = both.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*(F.expr(e) for e in INVOICE))).alias("n", "text"))
    return lines.select("doc_id", F.when(F.col("n") < 9, 1).otherwise(2).alias("page_number"), (F.col("n") + 1).alias("line_number"), "text")


LINES_SQL = f"""
lines AS (
  SELECT doc_id, CASE WHEN i < 10 THEN 1 ELSE 2 END AS page_number, CAST(i AS INTEGER) AS line_number, l[i] AS text
  FROM (SELECT o_orderkey AS doc_id, [{", ".join(INVOICE)}] AS l FROM orders JOIN customer ON o_custkey = c_custkey), range(1, {len(INVOICE) + 1}) AS t(i))
"""


def invoice_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderkey").alias("doc_id"), F.expr(_ASKED).alias("question"))


QUESTIONS_SQL = f"questions AS (SELECT o_orderkey AS question_id, o_orderkey AS doc_id, {_ASKED} AS question FROM orders)"


def line_chunks(lines: DataFrame) -> DataFrame:
    """Each line as a chunk."""
    return lines.select("doc_id", F.concat_ws("_", "doc_id", "line_number").alias("chunk_id"), F.col("line_number").cast("bigint").alias("chunk_idx"), "page_number", "text")


def order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, word_idx, text, confidence, x, y, width, height: four words a line item."""
    items = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
    each = [f"struct({k} AS col, {t} AS text, CAST({x} + l_partkey % 7 AS INT) AS x, {w} AS width)" for k, (t, x, w) in enumerate(WORDS)]
    words = items.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.expr(f"CAST({Y} AS INT)").alias("y"), F.explode(F.array(*(F.expr(e) for e in each))).alias("w"))
    return words.select(
        "doc_id", F.lit(1).alias("page_number"), (F.col("l_linenumber") * 4 + F.col("w.col")).alias("word_idx"), "w.text",
        (F.lit(0.5) + (F.col("l_linenumber") % 4) / 8).alias("confidence"), "w.x", "y", "w.width", F.lit(20).alias("height"),
    )


WORDS_SQL = "words AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey AS doc_id, 1 AS page_number, CAST(l_linenumber * 4 + {k} AS INTEGER) AS word_idx, {t} AS text, 0.5::DOUBLE + (l_linenumber % 4) / 8.0::DOUBLE AS confidence, CAST({x} + l_partkey % 7 AS INTEGER) AS x, CAST({Y} AS INTEGER) AS y, {w} AS width, 20 AS height FROM lineitem"
    for k, (t, x, w) in enumerate(WORDS)
) + ")"


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, table_id, cell_idx, x, y, width, height: two cells a line item, which hold its words."""
    items = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
    each = F.array(*(F.expr(f"struct({k} AS col, {x} AS x, {w} AS width)") for k, (x, w) in enumerate(((10, 110), (120, 200)))))
    cells = items.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.expr(f"CAST({Y} - 5 AS INT)").alias("y"), F.explode(each).alias("c"))
    return cells.select("doc_id", F.lit(1).alias("page_number"), F.lit("table_1").alias("table_id"), (F.col("l_linenumber") * 2 + F.col("c.col")).alias("cell_idx"), "c.x", "y", "c.width", F.lit(32).alias("height"))


CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey AS doc_id, 1 AS page_number, 'table_1' AS table_id, CAST(l_linenumber * 2 + {k} AS INTEGER) AS cell_idx, {x} AS x, CAST({Y} - 5 AS INTEGER) AS y, {w} AS width, 32 AS height FROM lineitem"
    for k, (x, w) in enumerate(((10, 110), (120, 200)))
) + ")"


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each customer; every fourth is revoked."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("key_id"), F.concat(F.lit("sk-live-"), F.col("c_custkey").cast("string")).alias("api_key"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 != 0).alias("is_active"))


KEYS_SQL = "keys AS (SELECT 'key-' || CAST(c_custkey AS STRING) AS key_id, 'sk-live-' || CAST(c_custkey AS STRING) AS api_key, c_name AS name, c_custkey % 4 <> 0 AS is_active FROM customer)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.concat(F.lit("sk-live-"), F.col("user_id").cast("string")).alias("api_key"), F.col("event_type").alias("endpoint"))


REQUESTS_SQL = "requests AS (SELECT event_id, ts, 'sk-live-' || CAST(user_id AS STRING) AS api_key, event_type AS endpoint FROM events)"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, length and header of a file for each part."""
    p = read(spark, sf_dir, "part")
    return p.select(F.expr(PATH).alias("path"), F.expr(LENGTH).alias("length"), F.unhex(F.expr(HEADER)).alias("header"))


PATH = "'in/' || replace(p_name, ' ', '$') || CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.jpg' END"
LENGTH = "CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 3000 END"
HEADER = "CASE p_partkey % 4 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '52494646AAAA' ELSE '0000' END"
