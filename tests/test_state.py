"""Index log, keys over time, status machine and envelope beyond what the SQL covers."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators import envelope, key_history, status
from leafmill.plans import state_queries
from leafmill.sources.chunk_index import ChunkIndex
from leafmill.streaming import status as stream

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, chunk_idx bigint, text string"


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "chunk_idx", "text").collect()))


@pytest.fixture
def index(spark, tmp_path):
    return ChunkIndex(spark, f"file://{tmp_path}/index", SCHEMA)


def chunks(spark, *listed):
    return spark.createDataFrame(list(listed), SCHEMA)


def test_an_empty_index(spark, index):
    assert index.version() == 0 and index.chunks().count() == 0 and index.documents().count() == 0 and index.compact() is None
    index.append(chunks(spark))
    assert index.version() == 1 and index.chunks().count() == 0


def test_append_replace_delete(spark, index):
    index.append(chunks(spark, (1, 0, "a"), (2, 0, "b"), (None, 0, "n")))
    index.append(chunks(spark, (1, 0, "a")))
    index.replace(chunks(spark, (2, 0, "B"), (3, 0, "c")))
    assert rows(index.chunks().where("doc_id is not null")) == [(1, 0, "a"), (1, 0, "a"), (2, 0, "B"), (3, 0, "c")]
    assert index.chunks().where("doc_id is null").count() == 1
    gone = index.delete(spark.createDataFrame([(1,), (9,)], "doc_id bigint"))
    assert [r["doc_id"] for r in gone.collect()] == [1]
    assert rows(index.chunks().where("doc_id is not null")) == [(2, 0, "B"), (3, 0, "c")]
    assert rows(index.chunks(2).where("doc_id is not null")) == [(1, 0, "a"), (1, 0, "a"), (2, 0, "b")]
    assert rows(index.document(3)) == [(3, 0, "c")]


def test_a_reader_keeps_its_snapshot_while_a_writer_fails(spark, index):
    index.append(chunks(spark, (1, 0, "a"), (2, 0, "b")))
    held = index.chunks()
    broken = chunks(spark, (1, 0, "x"), (5, 0, "y")).withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("torn"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="torn"):
        index.replace(broken)
    assert index.version() == 1 and rows(index.chunks()) == rows(held) == [(1, 0, "a"), (2, 0, "b")]
    index.replace(chunks(spark, (1, 0, "new")))
    index.compact()
    assert rows(held) == [(1, 0, "a"), (2, 0, "b")] and rows(index.chunks()) == [(1, 0, "new"), (2, 0, "b")]


def test_two_writers_at_once_both_count(spark, index, monkeypatch):
    index.append(chunks(spark, (1, 0, "a")))
    other, known = ChunkIndex(spark, index.path, SCHEMA), index.commits
    stale = known()
    monkeypatch.setattr(index, "commits", lambda version=None, first=iter([stale]): next(first, None) or known(version))
    other.append(chunks(spark, (2, 0, "b")))
    assert index.append(chunks(spark, (3, 0, "c"))) == 3
    assert rows(other.chunks()) == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]


def test_a_commit_between_base_and_compaction_stays(spark, index, monkeypatch):
    index.append(chunks(spark, (1, 0, "a"), (2, 0, "b")))
    save = index._save

    def slow(df, batch):
        save(df, batch)
        monkeypatch.setattr(index, "_save", save)
        index.replace(chunks(spark, (1, 0, "meanwhile")))

    monkeypatch.setattr(index, "_save", slow)
    index.compact()
    assert [c["kind"] for c in index.commits()] == ["append", "replace", "compact"]
    assert rows(index.chunks()) == [(1, 0, "meanwhile"), (2, 0, "b")]
    assert rows(index.chunks(1)) == [(1, 0, "a"), (2, 0, "b")]


def test_a_key_counts_once(spark, index):
    assert index.append(chunks(spark, (1, 0, "a")), key="s-0") == 1
    assert index.append(chunks(spark, (1, 0, "a")), key="s-0") is None
    assert rows(index.chunks()) == [(1, 0, "a")]


def test_vacuum_leaves_what_is_read(spark, index):
    for k in range(3):
        index.replace(chunks(spark, (1, 0, f"v{k}")))
    index.compact()
    index.append(chunks(spark, (2, 0, "z")))
    out = index.vacuum(index.version())
    assert len(out) == 6 and rows(index.chunks()) == [(1, 0, "v2"), (2, 0, "z")]
    assert index.vacuum(index.version()) == []


def test_the_kept_list_equals_a_recount_after_any_history(spark, tmp_path):
    rng = random.Random(11)
    for case in range(3):
        index, model = ChunkIndex(spark, f"file://{tmp_path}/{case}", SCHEMA), {}
        for step in range(7):
            docs = rng.sample(range(8), 3)
            batch = [(d, i, f"{step}.{i}") for d in docs for i in range(rng.randrange(1, 3))]
            kind = rng.choice(["append", "replace", "delete", "compact"])
            if kind == "append":
                index.append(chunks(spark, *batch), spark.createDataFrame([(docs[0], f"t{step}")], "doc_id bigint, title string"))
            elif kind == "replace":
                index.replace(chunks(spark, *batch))
            elif kind == "delete":
                index.delete(spark.createDataFrame([(d,) for d in docs], "doc_id bigint"))
            else:
                index.compact()
            if kind in ("replace", "delete"):
                model = {d: v for d, v in model.items() if d not in docs}
            if kind in ("append", "replace"):
                for d, i, t in batch:
                    model.setdefault(d, []).append((d, i, t))
        assert rows(index.chunks()) == sorted(x for v in model.values() for x in v)
        assert {r["doc_id"]: r["chunk_count"] for r in index.documents().collect()} == {d: len(v) for d, v in model.items()}
        assert all(r["first_indexed_at"] <= r["indexed_at"] for r in index.documents().collect())


def scans(plan):
    """The file scans of a plan that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    below = plan.children()
    return [plan] * (name == "FileSourceScanExec") + [x for i in range(below.size()) for x in scans(below.apply(i))]


def scan_rows(df):
    """Rows that the scans of chunks gave out."""
    df.collect()
    return sum(s.metrics().apply("numOutputRows").value() for s in scans(df._jdf.queryExecution().executedPlan()) if "/chunks/" in s.relation().location().rootPaths().toString())


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    index = ChunkIndex(spark, f"file://{tmp_path}/index", "doc_id string, chunk_idx bigint, text string", row_group=64 << 10)
    made = spark.range(60000).select(F.sha2((F.col("id") % 3000).cast("string"), 256).alias("doc_id"), (F.col("id") / 3000).cast("bigint").alias("chunk_idx"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    index.append(made.repartition(3))
    index.compact()
    one = made.first()["doc_id"]
    found = index.document(one)
    assert found.count() == 20
    read = scan_rows(index.chunks().where(F.col("doc_id") == one))
    assert 20 <= read < 6000, read
    assert index.document("absent").count() == 0


T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


HISTORY = "key_id string, api_key string, name string, at timestamp, action string"


def test_keys_over_time(spark):
    history = spark.createDataFrame(
        [("k1", "a", "n", at(10), "create"), ("k1", "a", "n", at(20), "revoke"), ("k1", "a", "n", at(25), "revoke"), ("k2", "a", "n", at(30), "create"), ("k2", "a", "n", at(40), "create"), ("k3", "b", "m", at(5), "create"), ("k4", "c", "o", at(7), "create"), ("k4", "c", "o", at(7), "revoke")], HISTORY
    )
    asked = [("a", 5), ("a", 10), ("a", 19), ("a", 20), ("a", 26), ("a", 30), ("a", 99), ("b", 4), ("b", 6), ("c", 8), ("z", 8), (None, 8)]
    requests = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(asked)], "id int, api_key string, ts timestamp")
    got = {r["id"]: (r["state"], r["key_id"], r["authorised"]) for r in key_history.requests_at_time(requests, history).collect()}
    want = [("absent", None), ("active", "k1"), ("active", "k1"), ("revoked", "k1"), ("revoked", "k1"), ("active", "k2"), ("active", "k2"), ("absent", None), ("active", "k3"), ("revoked", "k4"), ("unknown", None), ("unknown", None)]
    assert got == {i: (s, k, s == "active") for i, (s, k) in enumerate(want)}
    usage = {r["key_id"]: (r["request_count"], r["is_active"], r["revoked_at"]) for r in key_history.usage_over_time(requests, history).collect()}
    assert usage == {"k1": (2, False, at(20)), "k2": (2, True, None), "k3": (1, True, None)}
    later = key_history.revoked(history, spark.createDataFrame([("k3",), ("k1",), ("no",)], "key_id string"), at(50))
    assert later.count() == history.count() + 1
    state = lambda t, h: {r["api_key"]: r["state"] for r in key_history.requests_at_time(spark.createDataFrame([("a", at(t)), ("b", at(t))], "api_key string, ts timestamp"), h).collect()}
    assert state(49, later) == {"a": "active", "b": "active"} and state(51, later) == {"a": "active", "b": "revoked"}
    assert key_history.primary_at(history, at(12)).first()["key_id"] == "k3"
    assert key_history.primary_at(later, at(51)).first()["key_id"] == "k2"
    assert key_history.primary_at(history, at(1)).count() == 0


EVENTS = "doc_id bigint, at timestamp, status string, error string"


def fold(events, timeout, now):
    """The machine, event by event, on sorted and distinct events."""
    state = None
    for t, s, e in sorted({(int((t - T0).total_seconds() * 1000), s, e) for t, s, e in events}, key=lambda x: (x[0], status.RANK[x[1]], x[2] or "")):
        state = stream.advance(state or ("pending", t, 0, 0, None), t, s, e, timeout)
    return stream.advance(state, now, None, None, timeout)


def random_events(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice(list(status.RANK))
        out.append((rng.randrange(6), at(rng.randrange(600)), s, rng.choice(["x", "y"]) if s == "failed" else None))
    return out + rng.sample(out, 10)


def test_status_does_not_depend_on_the_order_of_rows(spark):
    events, timeout = random_events(3), 40 * 60000
    epoch = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = {}
    for d in {e[0] for e in events}:
        s = fold([e[1:] for e in events if e[0] == d], timeout, 700 * 60000)
        want[d] = (s[0], s[1] + epoch, *s[2:])
    for seed in range(3):
        random.Random(seed).shuffle(events)
        got = status.final_status(spark.createDataFrame(events, EVENTS), timeout, F.lit(epoch + 700 * 60000))
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_a_stream_gives_the_same_in_any_order_of_arrival(spark, tmp_path):
    events, timeout = random_events(4, 40), 40 * 60000
    batch = status.final_status(spark.createDataFrame(events, EVENTS), timeout, F.lit(int((at(700) - datetime(1970, 1, 1)).total_seconds() * 1000)))
    want = {r["doc_id"]: tuple(r)[1:] for r in batch.collect()}
    for seed in range(2):
        random.Random(seed).shuffle(events)
        here = f"{tmp_path}/{seed}"
        for k in range(4):
            spark.createDataFrame(events[k::4], EVENTS).coalesce(1).write.mode("append").parquet(f"{here}/in")
            raw = spark.readStream.schema(EVENTS).parquet(f"{here}/in")
            stream.start_status(raw, f"{here}/out", f"{here}/checkpoint", "30 hours", timeout).awaitTermination()
        # a tick far ahead, and one more, let the watermark pass everything up to minute 700
        spark.createDataFrame([(99, at(700 + 30 * 60), "pending", None)], EVENTS).coalesce(1).write.mode("append").parquet(f"{here}/in")
        raw = spark.readStream.schema(EVENTS).parquet(f"{here}/in")
        stream.start_status(raw, f"{here}/out", f"{here}/checkpoint", "30 hours", timeout).awaitTermination()
        got = stream.latest(spark.read.parquet(f"{here}/out").drop("batch")).where("doc_id <> 99")
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_envelope_of_sparse_documents(spark, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    documents = spark.createDataFrame([(1, "a.pdf", 2), (2, "b.pdf", 1)], "doc_id bigint, filename string, page_count int")
    pages = spark.createDataFrame([(1, 2, "", 0.0, 0), (1, 1, "x\ny", 0.5, 2), (3, 1, "lost", 1.0, 1)], "doc_id bigint, page_number int, full_text string, average_confidence double, words bigint")
    lines = spark.createDataFrame([(1, 1, 2, "y"), (1, 1, 1, "x"), (1, 7, 1, "no page")], "doc_id bigint, page_number int, line_number int, text string")
    fields = spark.createDataFrame([(1, 2, "f", "late"), (1, 1, "f", "early")], "doc_id bigint, place int, field string, value string")
    out = envelope.predictions(documents, pages, lines, empty("doc_id bigint, page_number int, table_idx int, rows array<array<string>>"), fields, empty("doc_id bigint, position int, key string, value string"))
    envelope.save(out, f"{tmp_path}/json")
    for df in (out, envelope.load(spark, f"{tmp_path}/json", out)):
        got = {r["doc_id"]: r.asDict(True) for r in df.collect()}
        assert set(got) == {1, 2}
        assert got[1]["raw_text"] == "x\ny\n" and got[1]["overall_confidence"] == 0.25 and got[1]["total_words"] == 2
        assert [(p["page_number"], p["line_count"], [x["text"] for x in p["lines"]]) for p in got[1]["pages"]] == [(1, 2, ["x", "y"]), (2, 0, [])]
        assert got[1]["fields"]["f"]["value"] == "early"
        assert (got[2]["raw_text"], got[2]["pages"], got[2]["overall_confidence"], got[2]["filename"]) == ("", [], 0.0, "b.pdf")


def test_an_envelope_moves_rows_once(spark):
    out = envelope.predictions(**state_queries.prediction_inputs(spark, SF))
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan.split("REPARTITION_BY_COL")[0]
    assert "Exchange" not in top.replace("Exchange hashpartitioning(doc_id", "", 1)


def test_folders_are_shared(spark):
    from leafmill.sources.shared import created, shared_folder

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/x"
    assert created(spark, path, "one") and not created(spark, path, "two")
    assert spark.read.text(path).first()[0] == "one"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_bytes(body)


def test_uploads_by_a_stream_count_once(spark, tmp_path):
    from leafmill.streaming.uploads import Uploads, start_uploads, stream_files

    put(tmp_path / "in", a__pdf=b"%PDF text one", b__pdf=b"%PDF text one", c__png=b"\x89PNG\r\n\x1a\n", d__exe=b"x", f__pdf=b" \n ")
    uploads = Uploads(spark, f"file://{tmp_path}/root")
    go = lambda: start_uploads(stream_files(spark, str(tmp_path / "in")), uploads, f"{tmp_path}/checkpoint").awaitTermination()
    seen = lambda: (sorted((r["name"], r["batch"]) for r in uploads.registry().collect()), sorted((r["name"], r["rejected"]) for r in uploads.quarantine().collect()), uploads.index.version())
    go()
    refused = [("c.png", "unreadable"), ("d.exe", "extension"), ("f.pdf", "blank text")]
    names, bad, version = seen()
    assert names == [("a.pdf", 0)] and bad == refused and version == 1
    go()
    assert seen() == (names, bad, version)
    put(tmp_path / "in", z__pdf=b"%PDF text one", g__pdf=b"%PDF other")
    go()
    assert ("g.pdf", 1) in seen()[0] and not any(n == "z.pdf" for n, _ in seen()[0])
    after = seen()
    # the last batch is run again, as after a failure between its writes
    uploads.ingest(spark.read.format("binaryFile").load([f"{tmp_path}/in/z.pdf", f"{tmp_path}/in/g.pdf"]), 1)
    assert seen() == after and uploads.index.documents().count() == len(after[0])
    one = uploads.registry().where("name = 'g.pdf'").first()["doc_id"]
    assert uploads.document(one).first()["name"] == "g.pdf"


def test_torn_files_are_reported(spark, tmp_path):
    from leafmill.sources import json_index

    chunk = spark.createDataFrame([(1, "1_0", 0, 1, "a"), (2, "2_0", 0, 1, "b")], json_index.CHUNK)
    json_index.write(chunk, spark.createDataFrame([(1, "One", 1), (3, "Three", 1)], json_index.META), str(tmp_path))
    put(tmp_path / "chunks", torn__json=b'{"doc_id": 5, "chunk_id": "5_0", "text": "x\n{"doc_id": 6, "chunk_id": "6_0", "chunk_idx": 0, "page_number": 1, "text": "ok"}\n{"other": 1}\n')
    chunks, documents, rejects = json_index.load(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in chunks.collect()) == [1, 2, 6]
    assert {r["doc_id"]: (r["title"], r["chunk_count"], r["state"]) for r in documents.collect()} == {1: ("One", 1, "indexed"), 2: ("2", 1, "untold"), 3: ("Three", 0, "missing"), 6: ("6", 1, "untold")}
    got = sorted((r["path"].rsplit("/", 1)[1], r["part"], r["reason"]) for r in rejects.collect())
    assert got == [("torn.json", "chunks", "no doc_id"), ("torn.json", "chunks", "no record")]
    put(tmp_path / "whole", x__json=b"1")
    (tmp_path / "whole" / "chunks").mkdir()
    (tmp_path / "whole" / "meta").mkdir()
    put(tmp_path / "whole" / "chunks", a__json=b'[{"doc_id": 1, "chunk_id": "c",\n "chunk_idx": 0}]', b__json=b'[{"doc_id": 2,')
    put(tmp_path / "whole" / "meta", a__json=b'[{"doc_id": 1, "title": "T"}]')
    _, documents, rejects = json_index.load(spark, str(tmp_path / "whole"), whole_files=True)
    assert [(r["doc_id"], r["state"]) for r in documents.collect()] == [(1, "indexed")]
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()] == [("b.json", "no record")]


def test_a_page_of_very_many_words(spark):
    """Cells and keys look at what is near them: time and joined rows follow the words, not their pairs."""
    from leafmill.operators import layout

    n = 50_000
    w = spark.range(n).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("word_idx"), F.when(F.col("id") % 5 == 0, "Key:").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text"),
        ((F.col("id") % 50) * 60).cast("int").alias("x"), ((F.col("id") / 50).cast("int") * 40).alias("y"), F.lit(40).alias("width"), F.lit(20).alias("height"), F.lit(0.9).alias("confidence"),
    )
    cells = w.where("word_idx % 2 = 0").select("doc_id", "page_number", F.lit("t").alias("table_id"), F.col("word_idx").alias("cell_idx"), F.col("x") - 5, F.col("y") - 5, F.lit(100).alias("width"), F.lit(30).alias("height")).toDF("doc_id", "page_number", "table_id", "cell_idx", "x", "y", "width", "height")
    got = {r["cell_idx"]: r["text"] for r in layout.cell_words(cells, w).collect()}
    assert len(got) == n // 2 and got[2] == "w2 w3" and got[0] == "Key: w1"
    pairs = layout.neighbours(w.withColumn("text", F.when(F.col("text") == "Key:", F.concat(F.lit("K"), F.col("word_idx").cast("string"), F.lit(":"))).otherwise(F.col("text"))))
    found = {r["key"]: r["value"] for r in pairs.collect()}
    assert len(found) == n // 5 and found["K0"].startswith("w1 w2 w3 w4 K5: w6")


def test_stored_vectors_move_neither_texts_nor_vectors(spark):
    from leafmill.operators import chunk, retrieve
    from leafmill.operators.stored import StoredChunks
    from leafmill.plans import text_queries

    chunks, questions = chunk.paragraph_chunks(text_queries._docs(spark, SF)), text_queries._questions(spark, SF)
    name = f"stored_{uuid.uuid4().hex}"
    store = StoredChunks(spark, name)
    store.add(chunks)
    top = store.best(questions)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    # shuffles carry questions, and then names and scores: the scored rows meet no exchange before Python has given up the vectors
    tree, below = plan.split("MapInArrow")[0], plan.split("MapInArrow")[1]
    assert "Exchange hashpartitioning(question_id" in tree and "Exchange hashpartitioning(_doc" in below
    assert not [line for line in below.splitlines() if "Exchange" in line and "question_id" in line]
    want = retrieve.top_k(retrieve.scored(questions, chunks, dense=True))
    named = lambda df: sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    a, b = named(top), named(want)
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2 and all(abs(x[3] - y[3]) < 2e-4 for x, y in zip(a, b, strict=True))
    texts = {(r["doc_id"], r["chunk_idx"]): r["text"] for r in chunks.collect()}
    told = store.with_texts(top).collect()
    assert len(told) == len(a) and all(r["text"] == texts[r["doc_id"], r["chunk_idx"]] for r in told)
    store.drop()
    assert not spark.catalog.tableExists(name)
