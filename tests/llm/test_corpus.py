"""Operators that compare texts with one another."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination, exact_dedup, near_dedup, sharding, suffix_dedup
from leafmill.llm.components import components
from tests.llm.brute import awkward, frame, leaked, near, normalised, repeats

SMALL = "/root/testdata/sf0.001"


def identified(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def near_corpus():
    """Chains of edited copies, many copies of one text, and one large group of near copies."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        t = random.choices(vocabulary, k=random.randint(20, 120))
        for _ in range(6):
            texts.append(" ".join(t))
            for _ in range(random.randint(1, 3)):
                t = [*t]
                t[random.randrange(len(t))] = random.choice(vocabulary)
    base = random.choices(vocabulary, k=100)
    for _ in range(120):
        t = [*base]
        for _ in range(random.randint(0, 5)):
            t[random.randrange(100)] = random.choice(vocabulary)
        texts.append(" ".join(t))
    texts += [texts[0]] * 40
    random.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates(spark):
    rows = near_corpus()
    want = near(rows)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = near([tuple(r) for r in small.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(small).collect()} == want


def test_blocks_of_a_mixed_bucket_meet_across_components_only(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    component = [0] * 60 + [1] * 7 + [2] * 3 + [3]
    met = [(5, i, c) for i, c in enumerate(component)] + [(6, i, 0) for i in range(30)]
    rows = near_dedup.across(spark.createDataFrame(met, "bucket long, id long, component long")).collect()
    assert {r["bucket"] for r in rows} == {5}
    groups = {}
    for r in rows:
        groups.setdefault((r["lo"], r["hi"]), []).append((r["id"], r["block"]))
    tested = Counter()
    for (lo, hi), members in groups.items():
        for a, x in members:
            for b, y in members:
                if (x, y) == (lo, hi) and (lo < hi or a < b):
                    tested[min(a, b), max(a, b)] += 1
    pairs = {(a, b) for a in range(len(component)) for b in range(a) if component[a] != component[b]}
    assert {(b, a) for a, b in pairs} <= set(tested)
    assert set(tested.values()) == {1}
    # 60 members meet the 3 blocks of the other 11, which meet 18 blocks
    assert len(rows) == 60 * 3 + 11 * 18


def edited(rng, size, share):
    """Two texts of size different words whose shingle sets have about that similarity: every edit in the middle takes five shingles."""
    a = [f"v{rng.randrange(10**9)}" for _ in range(size)]
    b = [*a]
    for k in range(round((size - 4) * (1 - share) / (1 + share) / 5)):
        b[10 + k * 10] += "x"
    return " ".join(a), " ".join(b)


def test_near_copies_of_the_pipeline(spark):
    """The stage takes similarities from 0.80 on, as brute force does, in small buckets and in large ones."""
    import corpus_pipeline

    rng = random.Random(5)
    pairs = [t for k in range(150) for t in edited(rng, rng.randrange(190, 260), 0.77 + 0.1 * k / 150)]
    rows = list(enumerate(pairs + [t for _, t in near_corpus()]))
    at80, at85 = near(rows, 80), near(rows, 85)
    assert sum(at80[i] != at85[i] for i in range(len(pairs))) > 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()} == {i for i in at80 if at80[i][1] == i}


def test_bands_and_margin_follow_the_threshold():
    """At the threshold, all bands are missed with MISSED at most, and random sketches stay within the margin."""
    rng = np.random.default_rng(2)
    for threshold in (50, 70, 80, 85, 95):
        by = near_dedup.plan(threshold)
        assert (1 - (threshold / 100) ** 5) ** by.bands <= near_dedup.MISSED
        differing = rng.binomial(by.samples, 1 - threshold / 100, 4000)
        ones = np.array([(np.bincount(rng.integers(0, 512, 2 * d), minlength=512) & 1).sum() for d in differing])
        assert abs((by.most_ones - ones.mean()) / ones.std() - near_dedup.MARGIN) < 0.5


def test_near_duplicates_awkward(spark):
    rows = awkward()
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = near(identified(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_exact_dedup_and_batches(spark):
    rows = awkward()
    index = exact_dedup.fresh_index(spark, "test")
    out = exact_dedup.deduplicate(frame(spark, rows), index, "first").collect()
    assert len(out) == len(rows)
    groups = Counter(normalised(r[1]) for r in rows)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[normalised(r[1])] = min(least.get(normalised(r[1]), r[0]), r[0])
    texts = {r[0]: normalised(r[1]) for r in rows}
    for r in out:
        t = texts[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (least[t], groups[t], r["doc_id"] == least[t])
    new = [(100, "brand new", *rows[0][2:]), (101, rows[0][1], *rows[0][2:]), (102, "brand  new", *rows[0][2:])]
    assert [r["doc_id"] for r in exact_dedup.kept_rows(frame(spark, new), index, "second").collect()] == [100]
    assert index.read().count() == len(least) + 1
    exact_dedup.kept_rows(frame(spark, new), index, "third")
    assert index.read().count() == len(least) + 1
    again = exact_dedup.fresh_index(spark, "empty")
    assert exact_dedup.deduplicate(frame(spark, []), again, "none").count() == 0


def test_suffix_dedup(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for rows, df in (([tuple(r) for r in small.collect()], small), (identified(awkward())[:13], frame(spark, [r for r in awkward() if r[0] is not None][:13]))):
        out = suffix_dedup.remove_repeats(df).withColumn("h", F.sha2("kept", 256)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in out} == repeats(rows)


def test_suffix_dedup_awkward(spark):
    rows = [r for r in awkward() if r[0] not in (13, 14)] + [(50, "ab" * 400, *awkward()[0][2:]), (51, "b" + "ab" * 90, *awkward()[0][2:])]
    out = suffix_dedup.remove_repeats(frame(spark, rows)).withColumn("h", F.sha2("kept", 256)).collect()
    assert len(out) == len(rows)
    want = repeats({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.values())
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("step, shards", [(1, 2), (4, 3), (20, 4)])
def test_merged_transforms_find_equal_prefixes(step, shards):
    random.seed(step)
    base = bytes(random.choice(b"abcd") for _ in range(300))
    segments = [base[o : o + n] for o, n in ((random.randint(0, 180), random.randint(100, 120)) for _ in range(9))]
    lengths = np.array([len(s) for s in segments])
    c = suffix_dedup.Collection(np.frombuffer(b"".join(segments), np.uint8), lengths, step)
    nodes, block = suffix_dedup.interleave(c, shards, 100 // step)
    assert sorted(nodes.tolist()) == sorted([*range(c.symbols), *(c.symbols + np.flatnonzero(~c.has_next))])
    windows = {}
    for x, b in zip(nodes.tolist(), block.tolist(), strict=True):
        if x < c.symbols and c.at[x] + 100 <= lengths[c.segment[x]]:
            windows.setdefault(segments[c.segment[x]][c.at[x] : c.at[x] + 100], set()).add(b)
    assert all(len(b) == 1 for b in windows.values())
    assert len({b for s in windows.values() for b in s}) == len(windows)


def test_recut_judges_the_same():
    random.seed(1)
    base = bytes(random.choice(b"abcdefgh ") for _ in range(400))
    segments = [base[o : o + 130] for o in (0, 10, 20, 200, 205, 30)]
    data, lengths = np.frombuffer(b"".join(segments), np.uint8), np.full(6, 130)
    doc, start = np.arange(6), np.zeros(6, np.int64)

    def flagged(parts):
        out = set()
        for d, n, i, at in parts:
            flag, begin = suffix_dedup.repeated(d, n, i, at), np.concatenate([[0], np.cumsum(n - 99)])
            for k in range(len(n)):
                out |= {(int(i[k]), int(at[k] + p)) for p in np.flatnonzero(flag[begin[k] : begin[k + 1]])}
        return out

    whole = flagged([(data, lengths, doc, start)])
    size, suffix_dedup.MERGE_BYTES = suffix_dedup.MERGE_BYTES, 8
    try:
        assert flagged(suffix_dedup.recut(data, lengths, doc, start)) == whole
    finally:
        suffix_dedup.MERGE_BYTES = size


def test_decontamination(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    assert found == leaked(rows, [tuple(r) for r in items.collect()]) and found
    clean = {r["doc_id"] for r in decontamination.kept_rows(docs, items).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in found}


def test_decontamination_awkward(spark):
    question = "Which river flows past the old mill where the seven boats drift? It is the quiet and narrow river Lune"
    items = spark.createDataFrame([(1, question), (2, None), (3, ""), (4, "one two"), (5, " ".join(f"t{i}" for i in range(400)))], "item_id long, text string")
    rows = awkward() + [(60, f"Intro. {question.upper()}!", *awkward()[0][2:]), (61, " ".join(f"t{i}" for i in range(400)), *awkward()[0][2:]), (62, "well, one two.", *awkward()[0][2:])]
    df = frame(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, items).collect()}
    assert found == {(60, 1), (61, 5), (62, 4)}
    assert decontamination.kept_rows(df, items).columns == df.columns
    assert decontamination.kept_rows(df, items).count() == len(rows) - 3
    assert decontamination.leaks(frame(spark, []), items).count() == 0
    assert decontamination.leaks(df, items.limit(0)).count() == 0 and decontamination.kept_rows(df, items.limit(0)).count() == len(rows)


def cuttings(spark, items, rng):
    """Texts that hold a run of words of an item, or a piece of one, among other words; and their leaks by brute force."""
    texts = []
    for t in items:
        t = t.split()
        for share in (0.45, 0.5, 0.52, 0.6, 0.8, 1.0):
            run = min(len(t), -(-int(share * (len(t) - 4) * 1000) // 1000) + 5)
            at = rng.randrange(len(t) - run + 1)
            texts.append([f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(200))] + t[at : at + run] + [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(200))])
        texts += [["well", t[-1], "and"], ["see", *t[-4:], "there"], t[len(t) // 4 - 1 : 1 - len(t) // 4]]
    rows, listed = list(enumerate(" ".join(t) for t in texts)), list(enumerate(items))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string"), leaked(rows, listed), len(rows)


def test_long_items_are_judged_as_a_whole(spark):
    """No short tail of an item is a leak, and half of an item is one wherever its entries end."""
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (128, 129, 130, 132, 133, 256, 257, 700)]
    docs, benchmark, want, n = cuttings(spark, items, rng)
    out = decontamination.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(out) == len(want)
    assert decontamination.kept_rows(docs, benchmark).count() == n - len({d for d, _ in want})
    assert all(0.5 <= r["overlap"] <= 1 for r in out)


def test_half_of_an_item_in_common_words_is_retrieved(spark):
    """Items whose one half is words that all items have: texts that hold that half only, weigh little and are leaks all the same."""
    rng = random.Random(6)
    items = []
    for n in [60] * 30 + [200] * 5:
        rest = [f"r{rng.randrange(10**6)}" for _ in range(n // 2 - 4)]
        items.append([f"c{rng.randrange(40)}" for _ in range(n // 2 + 4)] + rest)
    texts = [t[: len(t) // 2 + k] for t in items for k in (1, 2, 4, 5)] + [rng.sample(t, len(t)) for t in items]
    rows, listed = ([(i, " ".join(t)) for i, t in enumerate(x)] for x in (texts, items))
    want = leaked(rows, listed)
    assert len(want) > 50
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()} == want


def test_scattered_pieces_of_an_item_are_found(spark):
    """Short runs of an item far apart in a text: whether they are a leak depends on their n-grams alone."""
    rng = random.Random(8)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (40, 60, 60, 200, 400)]
    rows = []
    for t in items:
        t = t.split()
        for piece in (7, 10, 12, 15, 20):
            for take in (0.5, 0.7, 1.0):
                text = []
                for at in range(0, len(t), piece):
                    if rng.random() < take:
                        text += t[at : at + piece] + [f"o{rng.randrange(10**6)}" for _ in range(400)]
                rows.append((len(rows), " ".join(text)))
    listed = list(enumerate(items))
    want = leaked(rows, listed)
    assert 20 < len(want) < len(rows)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()} == want


def test_pruned_retrieval_is_exhaustive():
    """Block-max pruning drops nothing that reaches the threshold."""
    rng = np.random.default_rng(3)
    rows = [{"item": i, "part": 0, "own": 60, "terms": rng.integers(1, 60, 30).tolist(), "answer_from": 20} for i in range(40)]
    frequency = Counter(t for r in rows for t in set(r["terms"]))
    s = decontamination.build_shard(rows, frequency, 40, 30.0)
    hashes = rng.integers(1, 60, 600).astype(np.uint64)
    start = np.arange(0, 560, 20)
    p, e, score = decontamination.retrieve(s, hashes, start, start + 40)
    want = {}
    for k, a in enumerate(start):
        have = set(hashes[a : a + 40].tolist())
        for entry in range(40):
            mine = np.flatnonzero(s.entry == entry)
            terms = s.terms[np.searchsorted(s.first, mine, "right") - 1]
            total = s.impact[mine][np.isin(terms, list(have))].sum()
            if total >= decontamination.MIN_SCORE:
                want[k, entry] = total
    assert set(zip(p.tolist(), e.tolist(), strict=True)) == set(want) and want
    assert np.allclose(score, [want[k] for k in zip(p.tolist(), e.tolist(), strict=True)], atol=1e-5)


def test_shards(spark):
    for rows in (awkward(), awkward()[:5], []):
        out = sharding.shard(frame(spark, rows)).collect()
        assert len(out) == len(rows)
        sizes = Counter(r["shard"] for r in out)
        assert not sizes or max(sizes.values()) - min(sizes.get(k, 0) for k in range(24)) <= 1
        for k, n in sizes.items():
            assert 0 <= k < 24 and sorted(r["slot"] for r in out if r["shard"] == k) == list(range(n))
        at = [r["curve_at"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
        assert at == sorted(at)
        for r in out:
            text = next((x[1] for x in rows if x[0] == r["doc_id"]), None) or ""
            import zlib

            assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())


def test_curve_steps_to_neighbours(spark):
    rows = sharding.curve(spark).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(4096))
    points = [(r["cell"] >> 8 & 15, r["cell"] >> 4 & 15, r["cell"] & 15) for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


def test_arrow_buffers_of_slices():
    from leafmill.llm.textbytes import buffer

    a = pa.array(["x", None, "yz", ""]).slice(1)
    data, offsets = buffer(a)
    assert data.tobytes() == b"yz" and offsets.tolist() == [0, 0, 2, 2]
