"""Cases that the registered queries' data does not show, and whole results of documents."""

import math
import os
import shutil
import subprocess
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import chunk, extract, images, layout, pages, retrieve
from leafmill.sources import files

WORD = "doc_id long, page_number int, word_idx int, text string, x int, y int, width int, height int"
LINE = "doc_id long, page_number int, line_number int, text string"


def test_a_key_counts_once_a_page(spark):
    rows = [(1, 1, 0, "Qty:", 10, 10, 40, 20), (1, 1, 1, "3", 70, 10, 20, 20), (1, 1, 2, "qty:", 10, 60, 40, 20), (1, 1, 3, "4", 70, 60, 20, 20), (1, 2, 0, "Qty:", 10, 10, 40, 20), (1, 2, 1, "5", 70, 10, 20, 20)]
    got = sorted((r["page_number"], r["key"], r["value"]) for r in layout.neighbours(spark.createDataFrame(rows, WORD)).collect())
    assert got == [(1, "Qty", "3"), (2, "Qty", "5")]


def test_one_run_of_ink_replaces_the_box(spark):
    schema = "doc_id long, page_number int, box_idx int, x int, y int, width int, height int, projection array<int>"
    boxes = [(1, 1, 0, 0, 100, 50, 60, [0] * 5 + [9] * 30 + [0] * 25), (1, 1, 1, 0, 300, 50, 60, []), (1, 1, 2, 0, 400, 50, 60, [0] * 60), (1, 1, 3, 0, 500, 50, 60, [9] * 4 + [0] * 56)]
    got = {r["box_idx"]: (r["y"], r["height"]) for r in images.ink_runs(spark.createDataFrame(boxes, schema)).collect()}
    assert got == {0: (105, 30), 1: (300, 60), 2: (400, 60), 3: (500, 60)}
    tall = spark.createDataFrame([(1, 1, 0, 0, 0, 50, 3000, [9, 9, 0] * 1000)], schema)
    started = time.time()
    assert images.ink_runs(tall).count() == 1 and time.time() - started < 10


def test_blank_lines_and_empty_pages(spark):
    lines = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, " \t "), (1, 1, 3, "b"), (1, 3, 1, "c")], LINE)
    words = spark.createDataFrame([(1, 1, "a", 0.8), (1, 3, "c", 0.4)], "doc_id long, page_number int, text string, confidence double")
    listed = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page_number int")
    found = pages.page_results(lines, words, listed)
    assert {r["page_number"]: (r["full_text"], r["average_confidence"]) for r in found.collect()} == {1: ("a\nb", 0.8), 2: ("", 0.0), 3: ("c", 0.4)}
    assert pages.document_results(found).first()["overall_confidence"] == 0.4
    assert pages.document_text(found).first()["full_text"] == "a\nb\n\n--- PAGE BREAK ---\n\nc"


def test_glyphs(spark):
    cases = [([], 0.95), ([10, 10, 10], 0.95), ([10, 20, 12], 0.877), ([0, 0], 0.95), ([1, 40], 0.5)]
    df = spark.createDataFrame([(k, [float(v) for v in h]) for k, (h, _) in enumerate(cases)], "k int, h array<double>")
    got = {r["k"]: r["c"] for r in df.select("k", images.glyph_confidence(F.col("h")).alias("c")).collect()}
    for k, (h, _) in enumerate(cases):
        median, variance = (np.median(h), np.var(h)) if h else (10, 0)
        assert got[k] == round(max(0.5, min(0.95, 1 - variance / max(median**2, 1))), 3)


def test_long_paragraphs_take_time_in_proportion(spark):
    seconds = []
    for n in (2_000, 40_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
        chunk.paragraph_chunks(docs).count()
        started = time.time()
        assert chunk.paragraph_chunks(docs).count() == math.ceil(n / 30)
        seconds.append(time.time() - started)
    assert seconds[1] < 3


def test_extraction_results(spark):
    texts = ["Hill Traders Ltd", "Date: 15/01/2024", "Buyer = Ada Lovelace", "Payable: 120.50", "Grade: A", "Grade: B", "Invoice No: INV-77"]
    lines = spark.createDataFrame([(1, 1, k + 1, t) for k, t in enumerate(texts)] + [(2, 1, 1, "nothing here")], LINE)
    words = spark.createDataFrame([(1, 1, 0, "Ward:", 10, 10, 40, 20), (1, 1, 1, "9", 70, 10, 20, 20), (1, 1, 2, "Grade:", 10, 60, 40, 20), (1, 1, 3, "C", 70, 60, 20, 20)], WORD)
    out = {r["doc_id"]: r for r in extract.extraction_results(lines, words, spark.createDataFrame([(2, "receipt")], "doc_id long, document_type string")).collect()}
    fields = {f["field"]: (f["name"], f["value"], f["method"], f["confidence"]) for f in out[1]["fields"]}
    assert fields["vendor_name"] == ("Vendor Name", "Hill Traders Ltd", "rule_based", 0.91)
    assert fields["invoice_number"][1:3] == ("INV-77", "regex") and fields["invoice_date"][1] == "2024-01-15"
    assert fields["customer_name"] == ("Customer Name", "Ada Lovelace", "spatial_kv", 0.9)
    assert fields["total_amount"] == ("Total Amount", "120.50", "spatial_kv", 0.9)
    assert fields["grade"] == ("Grade", "A", "form_field", 0.9) and fields["ward"] == ("Ward", "9", "form_field", 0.87)
    assert [p["key"] for p in out[1]["key_values"]] == ["Date", "Buyer", "Payable", "Grade", "Invoice No", "Ward"]
    assert out[1]["summary"] == "Classified as INVOICE. Number: INV-77. Name: Ada Lovelace. Date: 2024-01-15. Total: 120.5."
    mean = sum(f["confidence"] for f in out[1]["fields"]) / len(out[1]["fields"])
    assert out[1]["overall_confidence"] == round(mean, 3)
    assert (out[2]["document_type"], out[2]["overall_confidence"], out[2]["fields"]) == ("receipt", 0.85, None)
    exported = {r["name"]: r["method"] for r in extract.export_rows(extract.all_fields(lines, extract.key_values(lines)), extract.key_values(lines)).where("doc_id = 1").collect()}
    assert exported["Vendor Name"] == "rule_based" and exported["Customer Name"] == "spatial_kv"


def test_completions(spark):
    messages = [(1, 0, "system", "Use doc_id: 7 please"), (1, 1, "user", "What is the total?"), (2, 0, "user", "first"), (2, 1, "user", ""), (3, 0, "user", "What is the total?"), (4, 0, "user", "total?"), (5, 0, "system", "x")]
    m = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    requests = spark.createDataFrame([(1, ""), (3, "9")], "conv_id long, doc_id string")
    chunks = spark.createDataFrame([(7, "7_0", 0, 1, "Total: 12.50"), (8, "8_0", 0, 2, "Total: 99.00")], "doc_id long, chunk_id string, chunk_idx long, page_number int, text string").withColumn("bbox", F.lit("box"))
    indexed = spark.createDataFrame([(7, 1), (8, 2)], "doc_id long, indexed_at long")
    out = {r["conv_id"]: r for r in retrieve.completions(m, requests, chunks, indexed).collect()}
    assert "12.50" in out[1]["answer"] and out[1]["citations"][0]["bbox"] == "box" and out[1]["prompt_tokens"] == 8
    assert out[2]["answer"].startswith("Please ask") and out[5]["answer"].startswith("Please ask")
    assert "doc_id '9'" in out[3]["answer"] and out[3]["citations"] == [] and out[3]["confidence_score"] == 0
    assert "99.00" in out[4]["answer"] and out[4]["total_tokens"] == out[4]["prompt_tokens"] + len(out[4]["answer"].split())
    none = {r["conv_id"]: r["answer"] for r in retrieve.completions(m, requests.limit(0), chunks.limit(0), indexed.limit(0)).collect()}
    assert none[4].startswith("Custom Model response to: 'total?'")


def test_ocr_chunks(spark):
    lines = [(1, 1, k, t, b) for k, (t, b) in enumerate([("a", None), ("b", "B"), (" ", "-"), ("c", "C"), ("d", "D")])] + [(1, 2, 0, "e", None)]
    fields = spark.createDataFrame([(1, 1, "invoice_number", "N1")], "doc_id long, position int, field string, value string")
    tables = spark.createDataFrame([(1, 1, 0, [["x", "y"], [" "]]), (1, 2, 1, [["z"]])], "doc_id long, page_number int, table_idx int, rows array<array<string>>")
    out = chunk.ocr_chunks(spark.createDataFrame(lines, LINE + ", bbox string"), fields, tables).orderBy("chunk_idx").collect()
    assert [(r["chunk_id"], r["text"], r["bbox"], r["line_count"]) for r in out] == [
        ("1_summary", "Structured Document Entities:\nInvoice Number: N1", None, None), ("1_t0_r0", "Table 1 Row 1: x | y", None, None), ("1_t1_r0", "Table 2 Row 1: z", None, None),
        ("1_p1_3", "a b c", "B", 3), ("1_p1_4", "c d", "C", None), ("1_p2_5", "e", None, None),
    ]
    assert [tuple(r) for r in chunk.document_meta(chunk.ocr_chunks(spark.createDataFrame(lines, LINE + ", bbox string"))).collect()] == [(1, "1", 3)]


def test_image_steps(spark):
    image = np.full((60, 90, 3), 230, np.uint8)
    image[20:26, 10:80] = 20
    df = spark.createDataFrame([("a", 60, 90, 3, bytearray(image.tobytes()))], "origin string, height int, width int, nChannels int, data binary")
    functions = {"half": lambda x: x[::2, ::2], "grey": images.grey, "ink": lambda x: np.where(x > 128, 255, 0).astype(np.uint8)}
    rows = images.steps(df, functions).orderBy("step").collect()
    assert [(r["step_key"], r["height"], r["nChannels"]) for r in rows] == [("original", 60, 3), ("half", 30, 3), ("grey", 30, 1), ("ink", 30, 1)]
    last = np.frombuffer(rows[-1]["data"], np.uint8).reshape(30, 45)
    assert last[11, 20] == 0 and last[25, 20] == 255
    assert [r["step_key"] for r in images.steps(df, functions, ("half",)).orderBy("step").collect()] == ["original", "grey", "ink"]
    boxes = spark.createDataFrame([(1, -5, 2, 20, 10, 100, 50), (2, 98, 10, 20, 20, 100, 50)], "k int, x int, y int, width int, height int, image_width int, image_height int")
    assert [(r["k"], r["x"], r["width"]) for r in images.patches(boxes).collect()] == [(1, 0, 15)]


def test_files_index_and_status(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "up" / "b.pdf").write_bytes(b"%PDF-1.7")
    read = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path / "up")).collect()}
    assert set(read) == {"a.png", "b.pdf"} and read["b.pdf"]["length"] == 8
    kinds = {r["name"]: (r["detected_type"], r["rejected"]) for r in files.validated(files.read_files(spark, str(tmp_path / "up"))).collect()}
    assert kinds == {"a.png": ("png", None), "b.pdf": ("pdf", None)}
    assert "not an image" in {r["rejected"] for r in files.read_images(spark, str(tmp_path / "up")).collect()}
    path = str(tmp_path / "index")
    files.write_index(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id long, text string"), path, replace=True)
    chunks, meta = files.load_index(spark, path, spark.createDataFrame([(2, "Second")], "doc_id long, title string"))
    assert chunks.count() == 3 and sorted(tuple(r) for r in meta.collect()) == [(1, "1", 2), (2, "Second", 1)]
    docs = spark.createDataFrame([(1, "new"), (2, "new")], "doc_id long, status string")
    events = spark.createDataFrame([(1, 1, "busy"), (1, 2, "done")], "doc_id long, at long, status string")
    assert sorted(tuple(r) for r in files.with_status(docs, events).collect()) == [(1, "done"), (2, "new")]


def test_without_the_optional_parts(tmp_path):
    """A copy without the llm folders and the pipeline imports, and lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
