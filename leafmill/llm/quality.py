"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Eight labellers vote good (1), bad (-1) or abstain (0) on each whole text.  They overlap and err; how often,
is estimated without true labels: a latent class model (good texts, and one class for each labeller's defect;
each labeller has a distribution of votes in each class) is fitted by expectation-maximisation to the
counts of vote patterns over all documents.  There are 3**8 patterns at most, so the counts are a small table whatever the corpus.  A
pattern's posterior is the label of its texts.

The scorer generalises from patterns to texts: a logistic model over hashed shapes of words, of word
pairs and of repetitions, trained on the posteriors of a bounded sample (TRAINED texts, about).  The sample is drawn
by pattern, evenly, so that patterns of rare defects are in it; a text of a thinned pattern weighs more.

Edge cases: a null or empty text, or one without words, has score 0 and is not kept (there is nothing to
keep); very long texts are blocks of their own; repeated rows are scored alike; an empty table gives no
rows; columns that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import spread, table, unused
from leafmill.llm.textbytes import Block, Words, blocks, mix, range_hashes, word_hashes, words

LABELLERS = ("repetition", "variety", "capitals", "signs", "columns", "sentences", "length", "lines")
#: Texts whose posteriors train the scorer (about), width of its features, and the least score of what is kept.
TRAINED, WIDTH, KEEP = 4000, 2048, 0.5
#: Texts that the prior of the labellers' votes weighs as much as.
PRIOR_TEXTS = 1

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = ~_LETTER[33:127]
_SIGN[48:58] = False
#: Classes of bytes in a word's shape: capital, other letter, digit, and each sign by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91], _SHAPE[48:58] = ord("A"), ord("0")


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[rows]).astype(float)


def vote(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return good.astype(np.int8) - (bad & ~good).astype(np.int8)


def votes(block: Block, w: Words, hashes: np.ndarray) -> np.ndarray:
    """A row of votes for each row of the block, in the order of LABELLERS."""
    d, n = block.data, np.diff(w.rows).astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(block.offsets), 1)
    row = w.row_of()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    again = row_sums(same, w.rows) / some
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = row_sums(new, w.rows) / some
    letters = row_sums(_LETTER[d], block.offsets)
    capitals = row_sums(_UPPER[d], block.offsets) / np.maximum(letters, 1)
    signs = row_sums(_SIGN[d], block.offsets) / size
    bars = row_sums((d == 124) | (d == 9), block.offsets) / some
    last = d[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    ending = row_sums(np.isin(last, [33, 46, 63]), w.rows) / some
    breaks = row_sums(d == 10, block.offsets) + 1
    none = np.zeros(len(n), bool)
    return np.column_stack([
        vote(again, (again > 0.12) & (n >= 5), none),
        vote(distinct, (distinct < 0.12) & (n >= 30), (distinct > 0.25) & (n >= 20)),
        vote(capitals, (capitals > 0.3) & (letters >= 30), none),
        vote(signs, (signs > 0.12) & (n >= 5), none),
        vote(bars, (bars > 0.08) & (n >= 5), none),
        vote(ending, ((ending > 0.6) | (ending < 0.005)) & (n >= 30), (ending > 0.02) & (ending < 0.35)),
        vote(n, none, n >= 40),
        vote(breaks, (n / breaks < 2.5) & (breaks >= 5), none),
    ]).astype(np.int8)


def shape_counts(block: Block, w: Words, hashes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed word shapes, pairs of shapes and repeated words, a row of WIDTH for each row of the block."""
    shape = _SHAPE[block.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    squeezed = shape[keep]
    h = range_hashes(squeezed, at[w.starts], at[w.ends])
    row = w.row_of()
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    joined = row[1:] == row[:-1]
    same = np.where(hashes[1:] == hashes[:-1], np.uint64(0xABCDEF), np.uint64(0xFEDCBA))
    out = np.zeros(block.rows * WIDTH)
    for r, code in ((row, h), (row[1:][joined], pair[joined]), (row[1:][joined], mix(same[joined]))):
        out += np.bincount(r * WIDTH + (code % np.uint64(WIDTH)).astype(np.int64), minlength=len(out))
    return np.sqrt(out.reshape(block.rows, WIDTH) / np.maximum(np.diff(w.rows), 1)[:, None]).astype(np.float32)


def parts(block: Block, rows: int = 512) -> Iterator[Block]:
    for lo in range(0, block.rows, rows):
        hi = min(lo + rows, block.rows)
        a, b = block.offsets[lo], block.offsets[hi]
        yield Block(block.lo + lo, block.lo + hi, block.data[a:b], block.offsets[lo : hi + 1] - a)


def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (pattern), the votes as one number in base 3; texts without words have none."""
    for batch in batches:
        for b in blocks(batch.column(0)):
            w = words(b)
            v = votes(b, w, word_hashes(b.data, w))
            pattern = ((v + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pattern[np.diff(w.rows) > 0].astype(np.int32))], names=["pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation: posterior of good for each pattern, P(vote | class) by class and labeller, and the classes' shares.

    Class 0 is good; class j + 1 has the defect that labeller j is for, and may show others.  So a text with
    one plain defect is bad although the other labellers find nothing.  The prior says that a good text
    rarely gets a bad vote, and a text with a defect mostly the one of its labeller; it weighs as much as
    PRIOR_TEXTS texts, whatever the corpus, so that a defect need not be common to be one.
    """
    k = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(k) % 3  # 0 bad, 1 abstain, 2 good
    one_hot = np.stack([v == x for x in range(3)], axis=2).astype(float)
    overall = np.einsum("p,pkx->kx", counts / counts.sum(), one_hot)
    rest = (overall[:, 1:] + 1e-6) / (overall[:, 1:] + 1e-6).sum(axis=1, keepdims=True)
    bad = np.full((k + 1, k), 0.05)
    bad[0] = 0.003
    bad[np.arange(1, k + 1), np.arange(k)] = 0.98
    lean = np.concatenate([bad[:, :, None], (1 - bad)[:, :, None] * rest[None]], axis=2)
    start = (v == 0).astype(float)
    share = np.column_stack([np.full(len(v), 0.1), 0.9 * start / np.maximum(start.sum(axis=1, keepdims=True), 1)])
    share[~start.any(axis=1)] = [0.97] + [0.03 / k] * k
    # a labeller that can find for or against a text tells nothing by abstaining (a text may be too short for it)
    both = overall[:, 2] > 0
    telling = one_hot.copy()
    telling[:, both, 1] = 0
    for _ in range(rounds):
        weight = share.T * counts
        held = weight.sum(axis=1)
        prior = (held + 1) / (held.sum() + k + 1)
        chance = (np.einsum("cp,pkx->ckx", weight, one_hot) + PRIOR_TEXTS * lean) / (held[:, None, None] + PRIOR_TEXTS)
        chance[:, both, 1] = 1e-9
        chance /= chance.sum(axis=2, keepdims=True)
        fit = np.log(prior)[:, None] + np.einsum("ckx,pkx->cp", np.log(chance), telling)
        now = np.exp(fit - fit.max(axis=0)).T
        now /= now.sum(axis=1, keepdims=True)
        moved, share = np.abs(now - share).max(), now
        if moved < 1e-9:
            break
    return share[:, 0], chance, prior


def rates(counts: np.ndarray, wanted: int) -> np.ndarray:
    """Share of each pattern's texts to draw: all of the rare ones, an equal number of the others, about ``wanted`` in total."""
    left, level = float(wanted), 0.0
    for k, n in enumerate(np.sort(counts)):
        level = left / (len(counts) - k)
        if n > level:
            break
        left -= n
    else:
        return np.ones(len(counts))
    return np.minimum(1.0, level / counts)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3e-5, rounds: int = 200) -> np.ndarray:
    """Logistic regression on weighted soft labels by accelerated gradient steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1], np.float32)
    look, t = w, 1.0
    step = 1.0 / (0.25 * float((weight * (x * x).sum(axis=1)).sum()) + penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - step * (x.T @ (weight * (p - y)).astype(np.float32) + penalty * look)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, dict]:
    """Weights of the scorer, and what the labellers turned out to be worth."""
    spark = docs.sparkSession
    found = docs.select(F.col(text)).mapInArrow(voted, "pattern int").groupBy("pattern").count().collect()
    if not found:
        return np.zeros(WIDTH + 1, np.float32), {}
    patterns, counts = (np.array([r[k] for r in found]) for k in range(2))
    good, chance, share = estimate(patterns, counts.astype(float))
    drawn = rates(counts, TRAINED)
    shared = spark.sparkContext.broadcast({int(p): (float(y), float(r)) for p, y, r in zip(patterns, good, drawn, strict=True)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn_at = batch.column(0).to_numpy() / float(1 << 63)
            for whole in blocks(batch.column(1)):
                for b in parts(whole):
                    w = words(b)
                    pattern = ((votes(b, w, word_hashes(b.data, w)) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
                    told = [shared.value[int(p)] if n else (0.0, 0.0) for p, n in zip(pattern, np.diff(w.rows), strict=True)]
                    y, rate = np.array(told).reshape(-1, 2).T
                    taken = np.flatnonzero(drawn_at[b.lo : b.hi] < rate)
                    if not len(taken):
                        continue
                    packed = []
                    for few in blocks(batch.column(1).take(pa.array(b.lo + taken))):
                        for c in parts(few):
                            w = words(c)
                            packed += [np.concatenate([np.flatnonzero(r).astype(np.float32), r[r > 0]]).tobytes() for r in shape_counts(c, w, word_hashes(c.data, w))]
                    yield pa.RecordBatch.from_arrays([pa.array(y[taken]), pa.array(1 / rate[taken]), pa.array(packed, pa.binary()), pa.array(drawn_at[b.lo + taken])], names=["y", "weight", "x", "at"])

    # about TRAINED rows; rows that repeat key and text are drawn together, and the limit holds however many they are
    sample = docs.select(spread("quality", key, text).alias("spread"), text).mapInArrow(features, "y double, weight double, x binary, at double")
    rows = sample.orderBy("at", "x").limit(4 * TRAINED).collect()
    if not rows:
        raise ValueError("the scorer's sample is empty")
    x = np.zeros((len(rows), WIDTH), np.float32)
    for r, row in zip(x, rows, strict=True):
        at, n = np.frombuffer(row["x"], np.float32).reshape(2, -1)
        r[at.astype(int)] = n
    accuracy = {name: {"its defect called bad": float(chance[j + 1, j, 0]), "good texts called bad": float(chance[0, j, 0])} for j, name in enumerate(LABELLERS)}
    return train(x, *(np.array([r[k] for r in rows]) for k in ("y", "weight"))), {"good": float(share[0]), "labellers": accuracy}


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, with score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in docs.columns if c not in (text, "score", "kept")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in blocks(batch.column(batch.num_columns - 1), 1 << 19):
                for b in parts(whole):
                    w = words(b)
                    p = 1 / (1 + np.exp(-np.clip(shape_counts(b, w, word_hashes(b.data, w)) @ shared.value[:-1] + shared.value[-1], -30, 30).astype(float)))
                    p[np.diff(w.rows) == 0] = 0
                    yield pa.RecordBatch.from_arrays([*(c.slice(b.lo, b.rows) for c in batch.columns[:-1]), pa.array(p), pa.array(p >= KEEP)], names=schema.names)

    return docs.select(*rest, F.col(text).alias(unused(docs, "_text"))).mapInArrow(run, schema)


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)[0])


QUERIES = {"op6_weak_label_quality": op6_weak_label_quality}
ORACLES: dict[str, str] = {}
