"""Packing, alignment and phrases against the libraries and plain-Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from leafmill.llm import alignment, bytelevel, packing, phrases, pieces
from leafmill.llm.textbytes import blocks
from tests.llm.brute import awkward, frame

SF = "/root/testdata/sf0.001"
A, B = bytelevel.default_model(), pieces.default_model()


@pytest.fixture(scope="module")
def library():
    return bytelevel.load(A, False)


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "don", "'", "'s", "'re", "'ll", "t", " ", "  ", "\n", "\t", "\xa0", "1", "23", "!", "?", "　", "é", "日本", "ß", "\x00", "́", "²", " '", "’", "😀", "<|endoftext|>"]
    return ["".join(rng.choice(parts[: 26 if i % 3 else 28]) for _ in range(rng.randrange(14))) for i in range(n)]


@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("plain", [False, True])
def test_byte_level_ids_are_the_library_s(prefix, plain):
    model, lib = bytelevel.load_model(A, plain), bytelevel.load(A, plain)
    encoder, told = model.encoder(prefix), texts(4000, 1)
    for b in blocks(pa.array(told), 5000):
        ids, rows = encoder.encode(b)
        for r in range(b.rows):
            assert ids[rows[r] : rows[r + 1]].tolist() == lib.encode(" " * prefix + told[b.lo + r], add_special_tokens=False).ids, told[b.lo + r]


def test_other_models_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bytelevel.load_model(public_tokenizers.path("word_bpe_49k.json"), False)


def test_words_are_compared_by_their_bytes(monkeypatch, library):
    monkeypatch.setattr(bytelevel, "_KEPT", {})
    monkeypatch.setattr(bytelevel, "range_hashes", lambda data, starts, ends: (np.asarray(ends - starts) % 3).astype(np.uint64))
    encoder = bytelevel.load_model(A, False).encoder()
    for t in ["the quick brown fox", "jumps over", "the fox", "naïve café"] * 2:
        for b in blocks(pa.array([t])):
            assert encoder.encode(b)[0].tolist() == library.encode(t).ids


def packed_well(out, rows, lib, capacity):
    """Every id once, in its place; sequences filled from 0 without a gap and not beyond the capacity."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    assert documents.keys() == want.keys()
    for i, found in documents.items():
        if len(want[i]) > 1:
            assert sum(r["length"] for r in found) == sum(map(len, want[i]))
            continue
        at, ids = 0, np.array(want[i][0], "<u4")
        for r in sorted(found, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            if r["ids"] is not None:
                assert bytes(r["ids"]) == part.tobytes()
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / (padding + sum(r["length"] for r in out)), len(sequences)


def test_cut_table():
    cuts = packing.cut_table(2048)
    assert all(sum(c) == r for r, c in enumerate(cuts)) and all(0 < x < 2048 for c in cuts for x in c)
    assert cuts[1024] == (1024,) and set(cuts[1500]) <= {136, 682} and max(map(len, cuts)) <= 4
    waste = sum(2048 / (2048 // x) - x for c in cuts for x in c) / sum(map(sum, cuts))
    assert waste < 0.02


def test_packing(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = packing.pack(docs.repartition(5), A).collect()
    padding, _ = packed_well(out, rows, library, 2048)
    assert padding < 0.02


def test_packing_in_several_rounds(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = packing.pack(docs.repartition(7), A, capacity=256)
    found = out.collect()
    padding, n = packed_well(found, rows, library, 256)
    assert padding < 0.03
    whole = packing.sequences(spark.createDataFrame(found, out.schema)).collect()
    assert len(whole) == n and all(sum(len(x) for x in r["ids"]) == 4 * r["length"] == 4 * sum(p["length"] for p in r["parts"]) for r in whole)


def test_packing_of_awkward_rows(spark, library):
    rows = awkward()
    out = packing.pack(frame(spark, rows), A, with_ids=False).collect()
    packed_well(out, [(r[0], r[1]) for r in rows], library, 2048)
    assert all(r["ids"] is None or r["sequence_id"] is not None for r in out)
    assert packing.pack(frame(spark, rows).limit(0), A).count() == 0


def aligned(rows):
    """Figures of each row by the libraries and a plain walk over both token lists."""
    lib, sp = bytelevel.load(A, True), sentencepiece.SentencePieceProcessor(model_file=B)
    data, offsets = bytelevel.token_bytes(bytelevel.load_model(A, True))
    told, counts = [], Counter()
    for i, t in rows:
        a, b = (lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        a_bytes = [data[offsets[x] : offsets[x + 1]].tobytes() for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in b)]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            told.append((i, 0, 0, [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, groups, j, last = [], [], 0, (0, 0)
        for k, e in enumerate(ends_a):
            while ends_b[j] <= e - len(a_bytes[k]):
                j += 1
            links += [(a[k], b[m]) for m in range(j, len(b)) if ends_b[m] - len(b_bytes[m]) < e]
        for e in sorted({*ends_a} & {*ends_b}):
            here = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[last[0] : here[0]])) + "|" + ",".join(map(str, b[last[1] : here[1]])))
            last = here
        counts.update(links)
        told.append((i, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, n_a, n_b, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), d) for i, n_a, n_b, g, ls, d in told]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t if len(t or "") < 30000 else t[:30000]) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(df, A, B).collect()
    assert sorted(tuple(r[c] for c in ALIGNED) for r in got) == sorted(aligned(rows))


def test_alignment_in_small_blocks_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 300)
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    rows += [(100 + i, t, *rows[0][2:]) for i, t in enumerate(["a▁b", "▁", " ", "日本語 <|endoftext|> </s> <0x0A>\n\t x", "\x00 nul 😀", "don't  stop"])]
    got = alignment.align(frame(spark, rows), A, B).collect()
    assert sorted((tuple(r[c] for c in ALIGNED) for r in got), key=str) == sorted(aligned([(r[0], r[1]) for r in rows]), key=str)
    assert alignment.align(frame(spark, rows).limit(0), A, B).count() == 0


def collocated(rows, least=30, best=2000, held=80):
    """The contract of op11, word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    q = p[i : i + k]
                    if 100 * a >= held * candidates[q]:
                        gone.add(q)
        rest = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rest.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


COLLOCATED = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_phrases(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = collocated([(r["lang"], r["text"]) for r in docs.collect()])
    got = phrases.collocations(docs.repartition(5)).select(*COLLOCATED).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 40


def test_phrases_over_many_small_batches(spark, monkeypatch):
    """Prefixes that go on over batches and tasks are counted once."""
    monkeypatch.setattr(phrases, "BLOCK", 200)
    rng = random.Random(5)
    rows = [(rng.choice(["en", None, "und", "fr"]), " ".join(rng.choice(["the", "The", "of", "in", "a.", "x,", "é", "b\tc", "z\n"]) for _ in range(rng.randrange(30)))) for _ in range(600)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = phrases.collocations(docs.repartition(6), least=3, best=50).select(*COLLOCATED).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == collocated(rows, 3, 50)


def test_phrases_of_awkward_rows(spark):
    rows = awkward()
    got = phrases.collocations(frame(spark, rows), least=2).select(*COLLOCATED).collect()
    assert sorted(map(tuple, got)) == collocated([(r[2], r[1]) for r in rows], 2)
    assert phrases.collocations(frame(spark, rows).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    counts = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", "a b", 2, big)], "lang string, phrase string, k int, f long")
    r = phrases.scored(counts).first()
    assert r["score"] == 2_000_000 * big // (2 * big + 3)
