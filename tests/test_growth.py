"""What queries shuffle and store, and rows that an order leaves open."""

import uuid

import numpy as np
import pyarrow as pa

from leafmill.operators import chunk, embed, extract, pages, retrieve
from leafmill.operators.stored import StoredChunks
from leafmill.plans import document_queries, synthetic, text_queries

SF = "/root/testdata/sf0.001"


def typed(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toJSON().replace(" ", "")


def test_no_vector_is_part_of_a_plan_that_answers(spark):
    questions, chunks = synthetic.invoice_questions(spark, SF), synthetic.line_chunks(synthetic.invoice_lines(spark, SF))
    assert '"elementType":"float"' in typed(embed.with_embedding(chunks, "text", "v"))
    assert '"elementType":"float"' not in typed(retrieve.query(questions, chunks, dense=True))


def test_a_store_holds_no_more_than_texts(spark):
    chunks = chunk.paragraph_chunks(text_queries._docs(spark, SF))
    store = StoredChunks(spark, f"stored_{uuid.uuid4().hex}")
    store.add(chunks)
    assert sorted(store.read().columns) == ["chunk_id", "chunk_idx", "doc_id", "page_number", "text"]
    assert not [kind for _, kind in store.read().dtypes if kind.startswith("array")]
    assert store.read().count() == chunks.count()
    store.drop()


def test_similarities_are_those_of_each_pair():
    rng = np.random.default_rng(4)
    texts = [[f"w{k}" for k in rng.integers(0, 30, n)] for n in (0, 1, 5, 40)]
    a, b = ([texts[k] for k in rng.integers(0, 4, 4500)] for _ in "ab")
    listed = lambda x: pa.array(x, pa.list_(pa.field("element", pa.string(), nullable=False)))
    one = lambda x: embed.Encoder().vectors(pa.array(x, pa.string()), np.array([len(x)]))[0].astype(float)
    got = embed.similarities(embed.Encoder(), listed(a).slice(7), listed(b).slice(7)).to_numpy()
    assert np.allclose(got, [one(x) @ one(y) for x, y in zip(a[7:], b[7:], strict=True)], atol=1e-6)
    assert len(embed.similarities(embed.Encoder(), listed([]), listed([]))) == 0


def test_details_gather_lines_once(spark):
    """Neither windows over all lines nor texts of pages: only a count of fields and words' confidences are asked."""
    plan = document_queries.doc_details(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "full_text" not in plan
    fields = extract.rule_fields(synthetic.invoice_lines(spark, SF)).groupBy("doc_id").count()
    counts = extract.field_counts(synthetic.invoice_lines(spark, SF))
    assert sorted(map(tuple, fields.collect())) == sorted(map(tuple, counts.collect()))


def test_fields_of_odd_documents(spark):
    blank = [(1, 1, n, "x") for n in range(1, 11)]
    rows = [
        *blank, (1, 1, 11, "Late Traders Ltd"), (1, 2, 5, "Hill Market"), (1, 2, 3, "* Coast Stores"), (1, 3, 1, "Total"), (1, 3, 2, "payable 12.50"),  # line 11 is too late; the last page's first; a total across lines
        (2, None, 1, "Total: $7.00"), (2, 1, 1, "Total: $9.00"), (2, 1, 2, "(98765) 43210 on 3 May 2024"), (2, 1, 3, "Phone: 123 456 789"),  # no page comes first; nine digits are no phone
        (3, 1, 1, None), (3, 1, 2, " "), (4, 1, 1, "Mobile: 9876500001"), (4, 1, 1, "Date: 2024-05-01"), (4, 1, 2, "Sold 5 Jun 2024"),
    ]
    lines = spark.createDataFrame(rows, "doc_id long, page_number int, line_number int, text string")
    got = {(r["doc_id"], r["field"]): (r["value"], r["page_number"], r["line_number"]) for r in extract.rule_fields(lines).collect()}
    assert got[1, "vendor_name"] == ("Coast Stores", 2, 3) and got[1, "total_amount"] == ("12.50", 1, None)
    assert got[2, "total_amount"] == ("7.00", None, 1) and (2, "phone") not in got
    assert got[4, "phone"] == ("9876500001", 1, 1) and got[4, "invoice_date"] == ("2024-05-01", 1, 1)
    assert not [k for k in got if k[0] == 3]
    want = {}
    for doc, _ in got:
        want[doc] = want.get(doc, 0) + 1
    assert dict(map(tuple, extract.field_counts(lines).collect())) == want


def test_blank_words_have_no_page(spark):
    rows = [(1, 1, " \t\u2003", 0.5), (2, 1, None, 0.5), (3, 1, "l0", 0.25), (3, 1, "", 0.75)]
    words = pages.clean_words(spark.createDataFrame(rows, "doc_id long, page_number int, text string, confidence double"))
    assert [(r["doc_id"], r["text"]) for r in words.collect()] == [(3, "10")]
    assert [tuple(r) for r in pages.page_means(words).collect()] == [(3, 1, 0.25, 1)]
