"""The registered queries: contracts, oracles and the pipeline against brute force."""

import duckdb
import sentencepiece

import corpus_pipeline
from leafmill.llm import pieces, registry
from tests.llm.brute import leaked, near, normalised

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        ours, theirs = registry.queries()[name](spark, SF), con.sql(sql)
        at = [theirs.columns.index(c) for c in ours.columns]
        assert sorted(str(tuple(r)) for r in ours.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall()), name


def test_one_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language_id", "op2_toxicity", "op3_suffix_dedup", "op5_hilbert_shards", "op6_weak_label_quality", "op9_minhash_odd_sketch", "op10_sentencepiece"):
        assert registry.queries()[name](spark, SF).count() == n, name
    assert {f"op{k}" for k in range(1, 14)} == {q.split("_")[0] for q in registry.queries()}


def test_pipeline(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in rows:
        first.setdefault(normalised(t), (i, t))
    rows = sorted(first.values())
    component = near(rows, 80)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    gone = {i for i, _ in leaked(rows, items)}
    want = {i: t for i, t in rows if i not in gone}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert all(r["ids"] == sp.encode(r["text"]) and r["decoded"] == sp.decode(r["ids"]) for r in out)
