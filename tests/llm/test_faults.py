"""Inputs that were once answered wrongly: texts written to collide, scarce letters, missing labels, other models."""

import random

import numpy as np
import pytest

import corpus_pipeline
from leafmill.llm import decontamination, language, near_dedup, pieces, suffix_dedup
from leafmill.llm.textbytes import _SEED, U64, lanes, mix, range_hashes
from tests.llm.brute import awkward, frame, near, repeats


def raw(*texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return data, ends - [len(t.encode()) for t in texts], ends


def twin(word, seed):
    """Another word of 16 letters with the hash that ``word`` has without a key: the second lane is solved for."""
    rng, n = random.Random(seed), len(word)
    start = lambda lane: mix(mix(np.array([n], U64) + _SEED) ^ lane)
    first, second = lanes(np.frombuffer(word.encode(), np.uint8))[[0, 8]]
    while True:
        other = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        lane = lanes(np.frombuffer(other.encode(), np.uint8))[:1]
        end = (second ^ start(first) * U64(3) ^ start(lane) * U64(3))[0]
        tail = int(end).to_bytes(8, "little")
        if all(33 <= b < 127 and not 65 <= b <= 90 for b in tail):
            return other + tail.decode()


def test_words_can_be_written_to_collide_without_a_key_only():
    word = "mntyadvygiwlhvgk"
    pairs = [(word, twin(word, k)) for k in range(3)] + [(word, "ugptbsayx_v>w)7%")]
    for a, b in pairs:
        assert a != b and len(set(range_hashes(*raw(a, b)).tolist())) == 1
        for key in (1, 2**63 + 5, 0x1234567):
            assert len(set(range_hashes(*raw(a, b), key).tolist())) == 2


def test_near_copies_are_not_made_by_colliding_words(spark):
    a = "mntyadvygiwlhvgk"
    lists = [[f"one two {w} four five", *(f"{w} x{i} y{i} z{i} u{i}" for i in range(2))] for w in (a, twin(a, 1), twin(a, 2))]
    rows = list(enumerate(t for listed in lists for t in listed))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near(rows)
    assert len({c for _, c in got.values()}) == len(rows)


def test_a_leak_is_not_made_by_colliding_words(spark):
    a = "mntyadvygiwlhvgk"
    item = f"the {a} of the narrow {a} river flows"
    docs = spark.createDataFrame([(1, item), (2, item.replace(a, twin(a, 3)))], "doc_id long, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in found] == [1]


@pytest.mark.parametrize("prune", [True, False])
def test_repeats_are_bytes_not_hashes(spark, prune):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    head, tail, word = letters(0), letters(84), "mntyadvygiwlhvgk"
    same, other = head + word + tail, head + twin(word, 4) + tail
    rows = [(1, same), (2, same), (3, other), (4, same + other), (5, other)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), prune=prune).collect()
    want = repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {i: w[:3] for i, w in want.items()}
    assert want[3][1] == 0 and want[5][1] == 100


def test_a_language_of_few_letters_is_learned(spark):
    rows = [(i, "1234 !!", "xx") for i in range(20000)] + [(20000 + i, f"nal ken {i} tor vim sela", "xx") for i in range(20)] + [(30000 + i, f"the quick brown fox {i} runs", "en") for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "xx"]


def test_a_corpus_without_labels_is_kept(spark):
    rows = [(1, "some text", None, "s", 1), (2, "12 !", None, "s", 1), (3, None, None, None, 0), (4, "日本", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.languages(spark, docs, "").collect()) == [1, 4]


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, awkward())
    items = "/root/testdata/sf0.001"
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, items)
            kept = out.select("doc_id", "text").collect()
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and len(kept) <= rows.count(), name
            rows = spark.createDataFrame(out.select(*corpus_pipeline.COLUMNS).collect(), out.select(*corpus_pipeline.COLUMNS).schema)
        texts = [r["text"] for r in rows.collect()]
        assert len(texts) == len(set(texts))
    assert all(any(c.isalpha() for c in t) for t in texts)


def test_other_piece_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    def changed(change):
        model = proto.ModelProto()
        with open(pieces.default_model(), "rb") as f:
            model.ParseFromString(f.read())
        change(model)
        (tmp_path / "m").write_bytes(model.SerializeToString())
        return str(tmp_path / "m")

    pieces.refuse_others(changed(lambda m: None))
    for change in (
        lambda m: setattr(m.trainer_spec, "model_type", proto.TrainerSpec.UNIGRAM), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
        lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.pieces[500], "type", proto.ModelProto.SentencePiece.USER_DEFINED),
    ):
        with pytest.raises(ValueError):
            pieces.load_vocabulary(changed(change))

