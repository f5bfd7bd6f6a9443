"""Operators against small plain-Python models and known cases."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions import text as X
from leafmill.operators import chunk, embed, extract, images, keys, layout, pages, retrieve
from leafmill.plans import synthetic, text_queries
from leafmill.sources import files
from leafmill.streaming import ingest


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, " a \t b\n\n\n\nc ", X.clean_text) == "a b\n\nc"
    assert one(spark, None, X.clean_text) == ""
    assert one(spark, "$ 1,250.50", X.parse_amount) == 1250.5
    assert one(spark, "1.2.3", X.parse_amount) is None
    assert one(spark, "lOO", X.repair_digits) == "lOO"
    assert one(spark, "1OSB", X.repair_digits) == "1058"
    assert one(spark, "A key:-no", X.field_key) == "a_key__no"
    for text, want in [("2024-1-5", "2024-01-05"), ("15/01/2024", "2024-01-15"), ("01/15/2024", "2024-01-15"), ("January 15, 2024", "2024-01-15"), ("15 Jan 2024", "2024-01-15"), ("soon", "soon"), ("", None)]:
        assert one(spark, text, X.standardize_date) == want, text


def py_embedding(text):
    import re

    words = re.sub(r"[^\w\s]", " ", text.lower()).split()
    tokens = list(words) + [w[i : i + 3] for w in words if len(w) >= 3 for i in range(len(w) - 2)] + [w[i : i + 4] for w in words if len(w) >= 5 for i in range(len(w) - 3)]
    v = np.zeros(384)
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        s = 1.0 if (h >> 16) % 2 == 0 else -1.0
        v[h % 384] += s * math.log1p(2.0 if len(t) > 3 else 1.5)
        v += 0.1 * s * embed.projection()[:, (h >> 8) % 128]
    n = np.linalg.norm(v)
    return v / n if n > 1e-6 else np.eye(1, 384)[0]


def test_embedding(spark):
    texts = ["The invoice total amount is 500", "Invoice amount due: 500", "Weather in the hills", "", "   "]
    rows = embed.with_embedding(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), "text", "v").orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        assert np.allclose(r["v"], py_embedding(t), atol=1e-5)
    a, b, c = (np.array(r["v"]) for r in rows[:3])
    assert a @ b > a @ c
    assert rows[3]["v"][0] == 1.0


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(95))
    docs = spark.createDataFrame([(1, f"  short one \n\n{long}"), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunk.paragraph_chunks(docs).orderBy("chunk_idx").collect()
    assert [r["chunk_id"] for r in rows] == [f"1_p1_c{i}" for i in range(5)]
    assert rows[0]["text"] == "short one" and rows[1]["text"].split() == [f"w{i}" for i in range(40)]
    for n in range(9):
        lines = spark.createDataFrame([(1, 1, i, f"l{i}") for i in range(n)] or [(9, 1, 0, " ")], "doc_id long, page_number int, line_number int, text string")
        assert chunk.line_windows(lines).count() == math.ceil(n / 2)


def test_hybrid_answer(spark):
    lines = ["Swift Logistics Pvt Ltd", "Invoice Number: LOG-2024-7", "Issue Date: 2024-05-01", "Freight charges: 900.00", "Total payable amount: $ 1,062.00"]
    chunks = spark.createDataFrame([(7, f"7_{i}", i, 1, t) for i, t in enumerate(lines)], "doc_id long, chunk_id string, chunk_idx long, page_number int, text string")
    asked = spark.createDataFrame([(1, 7, "What is the total payable amount?"), (2, 7, "What is the invoice number?"), (3, 8, "Anything?")], "question_id long, doc_id long, question string")
    out = {r["question_id"]: r for r in retrieve.query(asked, chunks).collect()}
    assert "1,062.00" in out[1]["answer"] and out[1]["confidence_score"] > 0.5
    assert "LOG-2024-7" in out[2]["answer"]
    assert out[3]["confidence_score"] == 0 and out[3]["retrieval_count"] == 0


def model_vector(text):
    """The hashed embedding in plain Python."""
    out, counts = np.zeros(384), np.zeros(128)
    for w in re.sub(r"[^\w\s]", " ", text.lower()).split():
        for t in [w, *(w[i : i + n] for n, least in ((3, 3), (4, 5)) if len(w) >= least for i in range(len(w) - n + 1))]:
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            sign = 1 if (h >> 16) % 2 == 0 else -1
            out[h % 384] += sign * np.log1p(2.0 if len(t) > 3 else 1.5)
            counts[(h >> 8) % 128] += sign
    out += 0.1 * embed.projection() @ counts
    return out / np.linalg.norm(out) if np.linalg.norm(out) > 1e-6 else np.eye(1, 384)[0]


def model_scores(questions, chunks):
    """question_id to the sorted hybrid scores of its document's chunks."""
    words = lambda t: set(re.sub(r"[^\w\s]", " ", t.lower()).split())
    mine, out = {q["doc_id"]: [] for q in questions}, {}
    for c in chunks:
        if c["doc_id"] in mine:
            mine[c["doc_id"]].append(c)
    vectors = {t: model_vector(t) for t in {c["text"] for m in mine.values() for c in m} | {q["question"] for q in questions}}
    for q in questions:
        asked = words(q["question"])
        for c in mine[q["doc_id"]]:
            number = any(re.search(r"\d", w) and w in c["text"].lower() for w in asked)
            dense = max(0.0, (float(vectors[q["question"]] @ vectors[c["text"]]) + 1) / 2)
            out.setdefault(q["question_id"], []).append(0.55 * dense + 0.35 * len(asked & words(c["text"])) / max(len(asked), 1) + 0.2 * number)
    return {q: sorted(s, reverse=True) for q, s in out.items()}


def test_registered_hybrid_queries_use_whole_questions_and_the_full_score(spark):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    text = {r["item_id"]: r["text"] for r in items.collect()}
    chunks = chunk.paragraph_chunks(docs.select("doc_id", "text")).select("doc_id", "text").collect()
    asked = [{"question_id": r["doc_id"], "doc_id": r["doc_id"], "question": text[r["doc_id"] % len(text)]} for r in docs.collect() if r["doc_id"] % len(text) in text]
    want = model_scores(asked, chunks)
    got = {}
    for r in sorted(text_queries.hybrid_retrieval(spark, d).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["score"])
    assert set(got) == set(want) and all(np.allclose(got[q], want[q][:4], atol=2e-4) for q in want)
    asked = synthetic.invoice_questions(spark, d).collect()
    some = [r for r in asked if r["question_id"] % 8 == 0]
    want = model_scores(some, synthetic.line_chunks(synthetic.invoice_lines(spark, d)).collect())
    cap = {"amount": lambda t: [min(0.98, t + 0.1)], "date": lambda t: [min(0.96, t + 0.1)], "number": lambda t: [min(0.95, t + 0.1)], "party": lambda t: [0.95, min(0.92, t)], "summary": lambda t: [t], "default": lambda t: [min(0.95, max(0.4, t))]}
    out = text_queries.hybrid_answers(spark, d).collect()
    assert len(out) == len(asked)
    for r in out:
        if r["intent"] != "none" and r["question_id"] in want:
            assert any(abs(r["confidence_score"] - c) < 2e-3 for c in cap[r["intent"]](want[r["question_id"]][0]))
            assert r["retrieval_count"] == min(4, len(want[r["question_id"]]))


def test_extraction(spark):
    texts = ["INVOICE", "Invoice Number: INV-2024-001", "Date: 15/01/2024", "Email: billing@acme.com", "Phone: +1 555-123-4567", "Total: $1,250.00"]
    lines = spark.createDataFrame([(1, 1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, line_number int, text string")
    got = {r["field"]: r for r in extract.rule_fields(lines).collect()}
    assert got["invoice_number"]["value"] == "INV-2024-001"
    assert got["invoice_date"]["value"] == "2024-01-15"
    assert got["total_amount"]["value_num"] == 1250.0
    assert got["email"]["value"] == "billing@acme.com"
    assert got["phone"]["value"].endswith("555-123-4567")
    across = spark.createDataFrame([(1, 1, 1, "Grand total"), (1, 1, 2, "in words and 99.50")], "doc_id long, page_number int, line_number int, text string")
    assert {r["field"]: (r["value_num"], r["confidence"]) for r in extract.rule_fields(across).collect()}["total_amount"] == (99.5, 0.92)
    kept = [("Sub total: 100", "total_amount"), ("Bank Name: Coast", "customer_name")]  # these readings are kept as they are
    for text, field in kept:
        row = spark.createDataFrame([(1, 1, 1, text)], "doc_id long, page_number int, line_number int, text string")
        assert field in {r["field"] for r in extract.rule_fields(row).collect()}


def py_merge(fields, pairs):
    """The merge as a loop over a dictionary; numbers and dates come in plain forms here."""
    taken, added = set(fields), []
    for position, key, value in pairs:
        low = key.lower()
        for field, words in fixed.KEY_WORDS.items():
            if any(w in low for w in words) and field not in taken:
                if field != "total_amount" or float(value or 0) > 0:
                    added.append((field, value, "spatial_kv", position))
                    taken.add(field)
                break
        else:
            name = "".join(c if c.isalnum() and c.isascii() or c == "_" else "_" for c in low.strip()).strip("_")
            if name and name not in taken and len(name) <= 30:
                added.append((name, value, "form_field", position))
                taken.add(name)
    return added


def test_merge(spark):
    random.seed(5)
    names = ["Invoice No", "Bill to name", "Date", "Due dt", "Total", "Amount", "Buyer", "Bank", "A/c", "IFSC", "Mobile", "Grade", "grade", "Very long key that goes beyond thirty"]
    docs = {d: [(i, random.choice(names), random.choice(["12", "0", "7"])) for i in range(8)] for d in range(30)}
    have = {d: random.sample(list(fixed.KEY_WORDS), 2) for d in docs if d % 3}
    kv = spark.createDataFrame([(d, *p) for d, ps in docs.items() for p in ps], "doc_id long, position int, key string, value string")
    fields = spark.createDataFrame([(d, f) for d, fs in have.items() for f in fs], "doc_id long, field string")
    got = sorted(tuple(r) for r in extract.merge_fields(fields, kv).collect())
    assert got == sorted((d, *a) for d, ps in docs.items() for a in py_merge(have.get(d, []), ps))


def py_lines(words):
    lines, current = [], []
    for w in sorted(words, key=lambda w: (w["y"], w["x"], w["i"])):
        if current:
            cy = sum(x["y"] + x["h"] / 2 for x in current) / len(current)
            height = sum(x["h"] for x in current) / len(current)
            if abs(w["y"] + w["h"] / 2 - cy) > height * 0.65:
                lines.append(current)
                current = []
        current.append(w)
    return [*lines, current]


def test_lines_by_running_mean(spark):
    random.seed(2)
    words = [{"i": i, "t": f"t{i}", "x": random.randint(0, 300), "y": random.randint(0, 200), "w": 30, "h": random.randint(10, 24)} for i in range(60)]
    rows = [(1, 1, w["i"], w["t"], 0.5, w["x"], w["y"], w["w"], w["h"]) for w in words]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, word_idx int, text string, confidence double, x int, y int, width int, height int")
    got = [(r["line_number"], r["text"]) for r in layout.assemble_lines(df).orderBy("line_number").collect()]
    want = [(n, " ".join(w["t"] for w in sorted(line, key=lambda w: w["x"]))) for n, line in enumerate(py_lines(words), 1)]
    assert got == want


def test_neighbours(spark):
    rows = [(0, "Name:", 10, 10, 60), (1, "Ada", 90, 12, 30), (2, "Lovelace", 130, 9, 60), (3, "far", 400, 10, 30), (4, "City:", 10, 60, 50), (5, "Paris", 12, 100, 50)]
    df = spark.createDataFrame([(1, 1, i, t, x, y, w, 20) for i, t, x, y, w in rows], "doc_id long, page_number int, word_idx int, text string, x int, y int, width int, height int")
    got = {r["key"]: (r["value"], r["confidence"]) for r in layout.neighbours(df).collect()}
    assert got == {"Name": ("Ada Lovelace", 0.87), "City": ("Paris", 0.82)}
    pairs = spark.createDataFrame([(1, 1, "name", "x")], "doc_id long, page_number int, key string, value string")
    assert [r["key"] for r in layout.new_keys(layout.neighbours(df), pairs).collect()] == ["City"]


def test_pages(spark):
    lines = spark.createDataFrame([(1, 1, 1, "a  b"), (1, 2, 1, "c")], "doc_id long, page_number int, line_number int, text string")
    words = spark.createDataFrame([(1, 1, "a", 0.5), (1, 1, "b", 0.6)], "doc_id long, page_number int, text string, confidence double")
    found = pages.page_results(lines, words)
    assert {r["page_number"]: r["average_confidence"] for r in found.collect()} == {1: 0.55, 2: 0.0}
    assert pages.document_results(found).first()["overall_confidence"] == 0.275
    assert pages.document_text(found, "|").first()["full_text"] == "a b|c"


def test_keys_and_files(spark):
    ks = spark.createDataFrame([("k1", "sk-1", True), ("k2", "sk-2", False)], "key_id string, api_key string, is_active boolean")
    rq = spark.createDataFrame([("sk-1", 1), ("sk-1", 2), ("sk-2", 3), ("bad", 4)], "api_key string, ts long")
    assert {r["key_id"]: r["request_count"] for r in keys.key_usage(rq, ks).collect()} == {"k1": 2, "k2": 0}
    got = spark.range(1).select(keys.presented(F.lit(" "), F.lit(None).cast("string"), F.lit("b"), F.lit("c"))).first()[0]
    assert got == "b"
    assert spark.range(1).select(files.decode_base64(F.lit("data:image/png;base64,aGk="))).first()[0] == b"hi"


def test_index_replace_append_delete(spark, tmp_path):
    path = str(tmp_path / "index")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    files.write_index(a, path, replace=True)
    files.write_index(spark.createDataFrame([(1, "z")], "doc_id long, text string"), path, replace=False)
    assert files.load_index(spark, path)[0].count() == 3
    files.write_index(spark.createDataFrame([(1, "new")], "doc_id long, text string"), path, replace=True)
    chunks, _ = files.load_index(spark, path)
    assert {(r["doc_id"], r["text"]) for r in chunks.collect()} == {(1, "new"), (2, "y")}
    left = files.without_document(chunks, spark.createDataFrame([(2,)], "doc_id long"))
    assert [r["doc_id"] for r in left.collect()] == [1]


def test_images(spark):
    pixels = np.zeros((20, 30, 3), np.uint8)
    pixels[5:12, 4:25] = 220
    df = spark.createDataFrame([("a", 20, 30, 3, bytearray(pixels.tobytes()))], "origin string, height int, width int, nChannels int, data binary")
    words = images.recognise(df, lambda p: [("hi", 0.9, 1, 2, 3, 4), (" ", 0.9, 1, 1, 1, 1), ("weak", 0.1, 1, 1, 1, 1)]).collect()
    assert [w["text"] for w in words] == ["hi"]
    size = spark.range(1).select(images.target_size(F.lit(4800), F.lit(1200))).first()[0]
    assert (size["width"], size["height"]) == (2400, 600)
    ink = [0] * 5 + [9] * 15 + [0] * 5 + [9] * 20 + [0] * 5
    boxes = spark.createDataFrame([(1, 1, 0, 3, 100, 40, 50, ink)], "doc_id long, page_number int, box_idx int, x int, y int, width int, height int, projection array<int>")
    assert [(r["y"], r["height"]) for r in images.ink_runs(boxes).orderBy("part").collect()] == [(105, 15), (125, 20)]


def test_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([(1, "one\ntwo")], "doc_id bigint, text string").write.parquet(source)
    for more, want in ((None, 2), ((2, "three"), 3)):
        if more:
            spark.createDataFrame([more], "doc_id bigint, text string").write.mode("append").parquet(source)
        ingest.start_ingest(ingest.stream_documents(spark, source), index, str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(index).count() == want
