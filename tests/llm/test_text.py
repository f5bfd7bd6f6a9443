"""Operators that judge each text by itself."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, language, pieces, quality, toxicity
from leafmill.llm.common import fold
from leafmill.llm.textbytes import LOWER, Block, blocks, shingles, word_hashes, words
from tests.llm.brute import awkward, frame, shingle_set

SF = "/root/testdata/sf0.01"


def test_words_and_shingles_in_any_block_size():
    texts = [r[1] for r in awkward()]
    for size in (1 << 20, 7):
        counts = []
        for b in blocks(pa.array(texts), size):
            w = words(b)
            raw = b.data.tobytes()
            for r in range(b.rows):
                found = [raw[s:e].decode() for s, e in zip(w.starts[w.rows[r] : w.rows[r + 1]], w.ends[w.rows[r] : w.rows[r + 1]], strict=True)]
                assert found == [x for x in re.split(r"[\x20\x09-\x0D]+", texts[b.lo + r] or "") if x]
            lower = Block(b.lo, b.hi, LOWER[b.data], b.offsets)
            s, rows = shingles(word_hashes(lower.data, w), w.rows, 5)
            counts += [len(set(s[rows[r] : rows[r + 1]].tolist())) for r in range(b.rows)]
        assert counts == [len(shingle_set(t)) for t in texts]


def test_language_accuracy_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(fold(F.col("doc_id")) != 1))
    out = language.predict(docs.where(fold(F.col("doc_id")) == 1), model)
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.98 * n
    rows = language.predict(frame(spark, awkward()), model).select("doc_id", "lang_pred", "score", "kept").collect()
    assert len(rows) == len(awkward())
    texts = [r[1] for r in awkward()]
    for r, t in zip(sorted(rows, key=lambda r: (r[0] is None, r[0])), [t for _, t in sorted(((r[0] is None, r[0] or 0, k), texts[k]) for k, r in enumerate(awkward()))], strict=True):
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")), t
        assert 0 <= r["score"] <= 1
    empty = frame(spark, [])
    assert language.predict(empty, language.fit(empty)).count() == 0
    unlearned = language.predict(frame(spark, awkward()), language.fit(empty))
    assert {r[0] for r in unlearned.select("lang_pred").collect()} == {"und"}


def toxic_corpus(n=1200):
    """Texts of made-up words; a tenth insults, by four words and one stem with many endings."""
    random.seed(11)
    plain = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(300)]
    bad = ["blockhead", "nitwit", "scoundrel", "dunderhead"]
    rows, labels = [], []
    for i in range(n):
        body = random.choices(plain, k=30)
        toxic = i % 10 == 0
        if toxic:
            for _ in range(2):
                body.insert(random.randrange(len(body)), random.choice([*bad, "grumf" + random.choice(plain)]))
        rows.append((i, " ".join(body), "en", "s", 1, *["c"] * 3, 1, "c", "c"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert ("nitwit", False) in model.terms and any(t.startswith("grum") and open_ for t, open_ in model.terms)
    cases = ["abc nitwitt def abc", "abc n1twit def abc", "you scoundrel abc", "abc grumfxyz and nitwit abc", 'she said "nitwit" yesterday', "abc def fed abc", "", None]
    out = toxicity.score(frame(spark, [(k, t, *rows[0][2:]) for k, t in enumerate(cases)]), model).orderBy("doc_id").collect()
    assert [bool(r["abusive_hits"] + r["quoted_hits"]) for r in out] == [True] * 5 + [False] * 3
    assert out[4]["quoted_hits"] == 1 and out[4]["score"] < out[2]["score"]
    assert out[3]["predicted"] == 1 and out[5]["predicted"] == 0 and out[6]["score"] == out[7]["score"] < 0.7
    assert toxicity.score(frame(spark, awkward()), model).count() == len(awkward())
    none = toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame(spark, awkward()), none).where("predicted = 1").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_automaton_is_levenshtein_one(seed):
    random.seed(seed)
    terms = ["abcde", "abxde", "edcbaab", "ab"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    a = toxicity.Automaton([(t, False) for t in terms])
    tests = ["".join(random.choice("abcdex") for _ in range(random.randint(1, 8))) for _ in range(3000)] + terms
    b = next(blocks(pa.array(tests), 1 << 30))
    got = a.walk(b.data, words(b))
    for t, g in zip(tests, got, strict=True):
        want = 1 if t in terms else 2 if any(len(u) >= 5 and distance(t, u) == 1 and _first_kept(t, u, distance) for u in terms) else 0
        assert g == want, (t, g, want)


def _first_kept(t, u, distance):
    """The first letter of a term must be there."""
    return t[:1] == u[:1] and distance(t[1:], u[1:]) <= 1


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    weights, worth = quality.fit(docs)
    assert 0.5 < worth["good"] < 1
    got = quality.score(docs, weights).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
    out = quality.score(frame(spark, awkward()), weights).select("doc_id", "score", "kept").collect()
    assert len(out) == len(awkward()) and {r["kept"] for r in out if r["doc_id"] in (5, 6, 7)} == {False}
    assert quality.score(frame(spark, []), quality.fit(frame(spark, []))[0]).count() == 0


def test_a_rare_defect_is_a_defect(spark):
    """One defect at 0.05 % and at 0.3 % beside common ones: its posterior and its texts' scores are bad."""
    powers = 3 ** np.arange(8)
    clean = np.array([1, 2, 1, 1, 1, 2, 2, 1])
    for share in (0.0005, 0.003):
        votes = np.array([clean, *(np.where(np.arange(8) == j, 0, clean) for j in (0, 2, 3, 4))])
        good, _, _ = quality.estimate((votes * powers).sum(axis=1), 1e6 * np.array([0.91 - share, 0.03, share, 0.03, 0.03]))
        assert good[0] > 0.9 and (good[1:] < 0.2).all()
    rng = random.Random(3)
    listed = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(600)]

    def text():
        return " ".join(" ".join(rng.choices(listed, k=rng.randint(6, 14))).capitalize() + "." for _ in range(6))

    for rare in (10, 60):
        made = [text() for _ in range(20_000)]
        for i in range(600):
            made[i] = re.sub(" ", " | ", made[i])
            made[600 + i] = re.sub(" ", " #%& ", made[600 + i])
        for i in range(rare):
            made[1200 + i] = made[1200 + i].upper()
        docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
        kept = {r["doc_id"] for r in quality.score(docs, quality.fit(docs)[0]).where("kept").collect()}
        assert not kept & set(range(1200, 1200 + rare)) and len(kept & set(range(1200 + rare, 20_000))) > 0.98 * (18_800 - rare)


def test_posteriors_follow_agreement():
    patterns = np.array([3280, 3279])  # all abstain; the first labeller says bad
    good, _, _ = quality.estimate(patterns, np.array([900.0, 100.0]))
    assert good[0] > 0.9 > 0.5 > good[1]


def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    random.seed(4)
    letters = "ab the. \n\t▁é日𝄞<0x>=-_/ÄÖß1234567890'\"{}()\x00 "
    texts = [r[1] for r in awkward()] + ["=-" * 300, "ab" * 2000, "  "] + ["".join(random.choice(letters) for _ in range(random.randint(0, 90))) for _ in range(400)]
    df = frame(spark, [(i, t, *awkward()[0][2:]) for i, t in enumerate(texts)])
    rows = pieces.encode(df, pieces.default_model()).select("doc_id", "ids", "decoded", "kept").orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = sp.encode(t or "")
        assert r["ids"] == want, t
        assert r["decoded"] == sp.decode(want), t
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in pieces.encode(docs.withColumn("t", F.col("text")), pieces.default_model(), "t").collect():
        assert r["ids"] == sp.encode(r["text"]) and r["decoded"] == sp.decode(r["ids"])
    assert pieces.encode(frame(spark, []), pieces.default_model()).count() == 0


def test_chat_round_trip(spark):
    talk = {
        1: [("system", "s | [x] <|a|>"), ("user", "\\l \\b"), ("assistant", "</s>"), ("user", None), ("assistant", "two\n"), ("user", "rest")],
        2: [("user", "only")], 3: [("assistant", ""), ("assistant", "x" * 50_000 + "<")], None: [("user", "u"), ("assistant", "a")], 4: [(None, "odd"), ("assistant", "日本")],
    }
    rows = [(c, k, role, text, "extra") for c, turns in talk.items() for k, (role, text) in enumerate(turns)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, context string"))
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for c, turns in talk.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r or "", t or "") for r, t in turns]
        assert got[c]["targets"] == [t or "" for r, t in turns if r == "assistant"]
    number = examples.groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in number} == {1: 3, 2: 1, 3: 2, None: 1, 4: 1}
    assert chat.read_back(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
