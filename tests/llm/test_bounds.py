"""Hashes, samples, merges and orders in cases that the tables do not show."""

import random
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafmill.llm import chat, common, decontamination, exact_dedup, language, near_dedup, pieces, sharding, suffix_dedup, toxicity
from leafmill.llm.textbytes import Block, Words, blocks, range_hashes, same_ranges, shingles, word_hashes, words
from tests.llm.brute import awkward, frame, near, normalised, repeats

SF = "/root/testdata/sf0.01"


def thue_morse(n):
    """Two words of n letters that polynomials modulo 2**64 cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_words_apart():
    rng = random.Random(1)
    texts = [*thue_morse(1024), *thue_morse(2048), *("".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 300))) for _ in range(4000))]
    b = next(blocks(pa.array(texts), 1 << 30))
    h = range_hashes(b.data, b.offsets[:-1], b.offsets[1:])
    assert len(set(h.tolist())) == len(set(texts)) and h[0] != h[1] and h[2] != h[3]
    order = np.array([rng.randrange(len(texts)) for _ in texts])
    same = same_ranges(b.data, b.offsets[:-1], b.offsets[1:], b.data, b.offsets[:-1][order], b.offsets[1:][order])
    assert same.tolist() == [t == texts[k] for t, k in zip(texts, order, strict=True)]


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse(2048)
    filler = " ".join(f"f{i}" for i in range(30))
    texts = [f"{a} {a} {a} {a} {a} {a}", f"{b} {b} {b} {b} {b} {b}", f"{filler} {a} {filler}", f"{filler} {b} {filler}", a, b]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == near(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(df, pieces.default_model()).collect()}
    assert all(got[i] == sp.encode(t) for i, t in rows)
    items = spark.createDataFrame([(1, f"{a} {a} {a} {a} {a} {a} {a}")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(df, items).collect()} == {0}


def test_remembered_segments_are_compared_by_their_bytes(monkeypatch):
    """With a hash that confuses nearly everything, the ids are the library's."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    monkeypatch.setattr(pieces, "range_hashes", lambda data, starts, ends: (np.asarray(ends - starts) % 3).astype(np.uint64))
    encoder = pieces.Encoder(pieces.load_vocabulary(pieces.default_model()))
    texts = ["the quick brown fox", "jumps over the lazy dog", "the fox", "brown dogs", "naïve café 日本"]
    for t in texts * 2:
        for b in blocks(pa.array([t])):
            assert encoder.encode(b)[0].tolist() == sp.encode(t)


@pytest.mark.parametrize("seed", range(4))
def test_merge_rounds_equal_one_merge_at_a_time(seed):
    """Vocabularies of any kind, also such in which a product's own pair comes before the next occurrence."""
    rng = random.Random(seed)
    letters, size = 3, 3
    pairs = {}
    for _ in range(40):
        left, right = rng.randrange(size), rng.randrange(size)
        if (left, right) not in pairs:
            pairs[left, right] = size
            size += 1
    ranks = list(range(len(pairs)))
    rng.shuffle(ranks)
    listed = sorted((left * size + right, rank, made) for ((left, right), made), rank in zip(pairs.items(), ranks, strict=True))
    v = pieces.Vocabulary(size, *(np.zeros(0, np.int64),) * 2, *(np.array(x) for x in zip(*listed, strict=True)), size, *(np.zeros(0),) * 4, True)
    rank_of = {k: (r, m) for k, r, m in listed}
    all_words = [[rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 30, 400]))] for _ in range(200)]
    symbols, segment = pieces.merge_rounds(v, np.concatenate([np.array(w) for w in all_words]), np.repeat(np.arange(200), [len(w) for w in all_words]))
    for k, w in enumerate(all_words):
        w = [*w]
        while True:
            found = min(((rank_of[x * size + y][0], i) for i, (x, y) in enumerate(zip(w, w[1:], strict=False)) if x * size + y in rank_of), default=None)
            if found is None:
                break
            i = found[1]
            w[i : i + 2] = [rank_of[w[i] * size + w[i + 1]][1]]
        assert symbols[segment == k].tolist() == w


def test_samples_are_bounded_at_any_size(spark):
    for count in (10**4, 10**9, 10**12, 10**15):
        below = common.threshold(800, count)
        assert 0 < below < 2**63 and abs(below / 2**63 * count - 800) < 1
    assert common.threshold(5, 0) == common.threshold(5, 5) == 2**63 - 1
    rows = [(i, "a" if i % 10 else "b", f"t{i}") for i in range(5000)] + [(7, "c", f"again {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = common.label_counts(df, "lang")
    samples = [sorted(map(tuple, common.bounded_sample(df.repartition(n), counts, "doc_id", "lang", 60, "s").collect())) for n in (1, 7)]
    assert samples[0] == samples[1] and all(0 < n <= 60 for n in Counter(r[1] for r in samples[0]).values()) and len({r[1] for r in samples[0]}) == 3
    with pytest.raises(ValueError):
        common.label_counts(df, "text", 10)


def test_more_than_two_hundred_languages(spark):
    rows = [(k * 4 + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (k * 7) % 26)}" for _ in range(12)), f"x{k:03d}") for k in range(230) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df)
    assert len(model.languages) == 230
    right = language.predict(df, model).where("lang = lang_pred").count()
    assert right > 0.95 * len(rows)


def test_the_language_decision_is_family_then_pairs(spark):
    """The vectorised prediction against one made text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r["text"] for r in docs.where("text is not null").limit(60).collect()]
    b = next(blocks(pa.array(texts), 1 << 30))
    names, _ = model.predict(language.gram_counts(b))
    for name, x in zip(names, language.gram_counts(b), strict=True):
        if not x.sum():
            continue
        family = model.families[int(np.argmax(model.grams @ x))]
        wins = {m: [0, 0.0] for m in model.members[family]}
        for (p, q), w in model.pairs.items():
            if p in wins:
                margin = float(x @ w) / np.linalg.norm(x)
                wins[p if margin > 0 else q][0] += 1
                wins[p][1], wins[q][1] = wins[p][1] + margin, wins[q][1] - margin
        assert name == max(wins, key=lambda m: (wins[m][0] + np.tanh(wins[m][1]) * 0.5))


@pytest.mark.parametrize("seed", range(2))
def test_the_whole_automaton_is_levenshtein_one(seed):
    rng = random.Random(seed)
    terms = ["abcde", "bcdea", "edcbaab", "ab"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    tests = ["".join(rng.choice("abcdex") for _ in range(rng.randint(1, 8))) for _ in range(3000)] + terms + ["bcde", "xbcde", "xabcde"]
    b = next(blocks(pa.array(tests), 1 << 30))
    for t, g in zip(tests, toxicity.Automaton([(t, False) for t in terms], keep_first=False).walk(b.data, words(b)), strict=True):
        assert g == (1 if t in terms else 2 if any(len(u) >= 5 and distance(t, u) == 1 for u in terms) else 0), t


def test_toxicity_fit_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (3, 7)]
    assert models[0].terms == models[1].terms and np.allclose(models[0].beta, models[1].beta)


def test_all_repeats_come_from_the_merge(spark):
    """With nothing pruned, and with a few minimisers dealt out further, the result is the same as by brute force."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(260)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(base) for _ in range(rng.randint(1, 4))) + str(i) * rng.randint(0, 150)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = repeats(rows)
    crowded = suffix_dedup.CROWDED_BYTES
    for prune, limit in ((True, crowded), (False, crowded), (True, 600)):
        suffix_dedup.CROWDED_BYTES = limit
        try:
            out = suffix_dedup.remove_repeats(df, prune=prune).withColumn("h", F.sha2("kept", 256)).collect()
        finally:
            suffix_dedup.CROWDED_BYTES = crowded
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in out} == want


def test_merged_transforms_are_in_the_order_of_bytes():
    """Nodes come in lexicographic order, and common prefixes are those of the strings."""
    rng = random.Random(9)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(300))
    segments = [base[o : o + 110] for o in (0, 5, 40, 100, 103, 0)]
    c = suffix_dedup.Collection(np.frombuffer(b"".join(segments), np.uint8), np.array([110] * 6))
    nodes, common_ = suffix_dedup.merge_transforms(c, np.array([0, 2, 3, 6]))
    inside = [(segments[c.segment[x]][c.at[x] : c.at[x] + 100], k) for k, x in enumerate(nodes.tolist()) if x < c.symbols and c.at[x] <= 10]
    assert [s for s, _ in inside] == sorted(s for s, _ in inside)
    for (s, i), (t, j) in zip(inside, inside[1:], strict=False):
        same = next((k for k in range(5) if s[20 * k : 20 * k + 20] != t[20 * k : 20 * k + 20]), 5)
        assert min(common_[i + 1 : j + 1]) == same


def test_settle_holds_one_row_between_batches():
    rng = np.random.default_rng(4)
    rows = sorted((int(k), int(s) + int(k) * 10, int(d), (int(a) << 16) | 2) for k, s, d, a in zip(*(rng.integers(0, n, 400) for n in (40, 3, 6, 4)), strict=True))
    names = ["k", "s", "id", "at"]

    def settled(cuts):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:j]], pa.int64()) for c in range(4)], names=names) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return sorted(str(tuple(r.values())) for b in suffix_dedup.settle()(iter(parts)) for r in b.to_pylist())

    whole = settled([0, 400])
    assert whole and all(settled(list(range(0, 401, step))) == whole for step in (1, 4, 50))


def test_second_batch_against_the_index(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, "second_batch_index")
    assert index.read().count() == 0
    exact_dedup.deduplicate(docs.where("doc_id % 2 = 0"), index, "first").count()
    got = exact_dedup.deduplicate(docs.where("doc_id % 2 = 1"), exact_dedup.DigestIndex(spark, "second_batch_index"), "second")
    want = duckdb.sql(f"""WITH t AS (SELECT doc_id, lower(sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS h FROM '{SF}/documents.parquet'),
      g AS (SELECT h, count(*) AS n, min(doc_id) AS first FROM t WHERE doc_id % 2 = 1 GROUP BY 1), old AS (SELECT h, min(doc_id) AS first FROM t WHERE doc_id % 2 = 0 GROUP BY 1)
      SELECT doc_id, coalesce(old.first, g.first), n, doc_id = coalesce(old.first, g.first), t.h FROM t JOIN g ON t.h = g.h LEFT JOIN old ON t.h = old.h WHERE doc_id % 2 = 1""").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = index.new(docs.select(exact_dedup.digest_of(F.col("text")).alias("digest")))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    index.drop()
    assert not spark.catalog.tableExists("second_batch_index")


def test_one_of_repeated_rows_stays(spark):
    rows = awkward() + [awkward()[0]] * 3 + [(None, "only null keys", *awkward()[0][2:])] * 2
    df = frame(spark, rows).withColumn("_digest", F.lit("theirs"))
    out = exact_dedup.kept_rows(df, exact_dedup.fresh_index(spark, "twins"), "b").collect()
    assert sorted(normalised(r["text"]) for r in out) == sorted({normalised(r[1]) for r in rows})
    assert {r["_digest"] for r in out} == {"theirs"}


def test_items_of_any_id_and_parts_verified_apart(spark):
    question, answer = "which of the narrow rivers flows past the old mill near the town of boats?", "it is the slow and quiet river lune of course"
    items = spark.createDataFrame([("q", f"{question} {answer}"), (None, "seven tall ships lie at anchor before the grey harbour wall today")], "item_id string, text string")
    docs = [(1, f"{question} {answer}"), (2, question), (3, f"see: {answer}"), (4, "today seven tall ships lie at anchor before the grey harbour wall today"), (5, "nothing of it")]
    out = {(r["doc_id"], r["item_id"]): r["verified"] for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert out[1, "q"] == "question and answer" and out[2, "q"] == "question" and (4, None) in out and (5, "q") not in out
    assert decontamination.kept_rows(spark.createDataFrame(docs, "doc_id long, text string"), items).where("doc_id = 4").count() == 0


def test_closed_blocks_are_not_read():
    """Postings are gathered from open blocks only; all that reaches its threshold is found."""
    rng = np.random.default_rng(5)
    rows = [{"item": i, "part": 0, "own": 80, "terms": rng.integers(i * 25, i * 25 + 30, 40).tolist(), "answer_from": 20} for i in range(64)]
    frequency = Counter(t for r in rows for t in set(r["terms"]))
    s = decontamination.build_shard(rows, frequency, 64, 40.0)
    read = []
    original = decontamination.gather_ranges
    decontamination.gather_ranges = lambda a, n: read.append(int(n.sum())) or original(a, n)
    try:
        opened = every = 0
        for r in rows:
            hashes = np.array(r["terms"], np.uint64)
            found = decontamination.retrieve(s, hashes, np.array([0]), np.array([40]))
            mine = np.flatnonzero(np.isin(s.terms, hashes))
            assert r["item"] in {s.items[e] for e in found[1]}
            opened, every = opened + read[-1], every + (s.first[mine + 1] - s.first[mine]).sum()
    finally:
        decontamination.gather_ranges = original
    assert opened < every


def test_ties_of_turns_go_by_their_text(spark):
    rows = [(1, 0, "user", "|"), (1, 0, "user", "a"), (1, 0, "user", "["), (1, 1, "assistant", "<"), (1, 1, "assistant", "<"), (1, 1, "assistant", "Z")]
    back = chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t["text"] for t in back["turns"]] == ["[", "a", "|", "<", "<", "Z"] and back["targets"] == ["<", "<", "Z"]


def test_shards_by_brute_force_and_groups_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = sharding.shard(docs).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    order = sorted(out, key=lambda r: (r["curve_at"], r["text_crc32"] >> 20, r["text_crc32"], r["size"], r["part"], r["doc_id"]))
    n = len(order)
    for rank, r in enumerate(order):
        k = max(k for k in range(24) if k * n // 24 <= rank)
        assert (r["shard"], r["slot"]) == (k, rank - k * n // 24)
    held = defaultdict(set)
    for r in out:
        held[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(s) > 1 for s in held.values()) <= 23 + 24
    # a shard spans less of the metadata than rows dealt out at random do
    seen, dealt = defaultdict(set), defaultdict(set)
    for k, r in enumerate(out):
        seen[r["shard"]].add((r["source"], r["lang"]))
        dealt[k % 24].add((r["source"], r["lang"]))
    assert sum(map(len, seen.values())) < 0.7 * sum(map(len, dealt.values()))


def test_shards_can_be_pruned_by_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = sharding.shard(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    span = out.groupBy("shard").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs")).collect()
    few = sorted(r["sources"] for r in span)
    # only the shards of the trailing run, at the end, span all sources
    assert len(span) == 24 and sum(few) / 24 < 8.5 and sum(few[:-3]) / 21 < 7
    split = out.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split <= 24



@pytest.mark.parametrize("width", [10, 40, 62])
def test_sorted_places_is_a_stable_order(width):
    rng = np.random.default_rng(width)
    key = rng.choice(rng.integers(0, 1 << width, 300), 5000)
    order, ordered = suffix_dedup.sorted_places(key, width)
    assert np.array_equal(order, np.argsort(key, kind="stable")) and np.array_equal(ordered, np.sort(key))


@pytest.mark.parametrize("size", [1, 4, 5, 6, 11, 20, 25])
def test_ranks_are_in_the_order_of_bytes(size):
    rng = random.Random(size)
    base = bytes(rng.choice(b"\x00a\xff") for _ in range(40))
    text = b"".join(base[rng.randrange(30) :] for _ in range(40))
    place = np.array(rng.sample(range(len(text) - size + 1), 200) + [len(text) - size])
    strings = [text[p : p + size] for p in place.tolist()]
    rank = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert suffix_dedup.byte_ranks(np.frombuffer(text, np.uint8), place, size).tolist() == [rank[s] for s in strings]


def test_symbols_are_not_sorted_by_their_places():
    """The merge's cost: permutations of symbols come from sorted numbers; only lists of segments are sorted by places, which costs several times as much."""
    rng = np.random.default_rng(6)
    n, base = 300, rng.integers(97, 101, 4000).astype(np.uint8)
    doc, at = np.arange(n), rng.integers(0, 4000 - 140, n)
    lengths = rng.integers(100, 140, n)
    data, sorted_by_place = np.concatenate([base[a : a + m] for a, m in zip(at, lengths, strict=True)]), []

    def seen(frame_, event, what):
        if event == "c_call" and what.__name__ == "argsort":
            sorted_by_place.append(len(what.__self__))

    sys.setprofile(seen)
    try:
        flag = suffix_dedup.repeated(data, lengths, doc, np.zeros(n, np.int64))
    finally:
        sys.setprofile(None)
    assert sorted_by_place and max(sorted_by_place) <= n
    begin, known, want = np.cumsum(lengths) - lengths, set(), []
    for b, m in zip(begin.tolist(), lengths.tolist(), strict=True):
        windows = [data[b + i : b + i + 100].tobytes() for i in range(m - 99)]
        want += [w in known for w in windows]
        known.update(windows)
    assert flag.tolist() == want
