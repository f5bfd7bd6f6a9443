"""Hierarchical language identification: first the family, then one-versus-one linear SVMs within it.

A text is a bag of hashed byte bigrams and trigrams of its letters (ASCII letters in lower case, other
characters as they are, everything else one gap).  A multinomial model of the grams picks the language
family; between the languages of the family, each pair has a linear support vector machine, trained by
dual coordinate descent on a bounded sample, and the language with the most pairwise wins is chosen
(margins break ties).  The score is the family's posterior times the probability that goes with the
weakest margin of the winner.

The sample holds PER_LANGUAGE rows of each language at most (documented bound of the fit), of all languages
that occur; more than 10,000 different labels are an error.  A prediction reads the whole text and nothing else.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0; a very long text is
a block of its own, whose arrays take some 30 times its size; repeated rows are predicted like any row; without any labelled row every text is
``und``; an empty table gives no rows; columns of the input that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import bounded_sample, fold, label_counts, table, unused, written
from leafmill.llm.textbytes import Block, blocks

#: Languages by family (ISO 639-1); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg mi ms su tl",
}
#: Width of the hashed feature vector, and the labelled rows of a language that the fit uses.
WIDTH, PER_LANGUAGE = 4096, 800
#: Rows and bytes that are counted at once.
ROWS, BYTES = 512, 1 << 19
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.split("-")[0] in members.split()), f"other:{language}")


def gram_counts(block: Block) -> np.ndarray:
    """Counts of the hashed grams, a row of WIDTH for each row of the block."""
    out = np.zeros((block.rows, WIDTH), np.float32)
    for lo in range(0, block.rows, ROWS):
        hi = min(lo + ROWS, block.rows)
        a, b = block.offsets[lo], block.offsets[hi]
        d = _LETTERS[block.data[a:b]].astype(np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(block.offsets[lo : hi + 1]))
        total = np.zeros((hi - lo) * WIDTH, np.int64)
        two = (d[:-1] << 8) | d[1:]
        for gram, ends in ((two, row[1:]), ((two[:-1] << 8) | d[2:], row[2:])):
            same = (row[: len(ends)] == ends) & ((gram & 0xFF) != 32)
            code = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            total += np.bincount((ends.astype(np.int64) * WIDTH + code)[same], minlength=len(total))
        out[lo:hi] = total.reshape(hi - lo, WIDTH)
    return out


def train_pair(x: np.ndarray, y: np.ndarray, c: float = 8.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1, rows of x have length 1."""
    w, alpha, diagonal = np.zeros(x.shape[1], np.float32), np.zeros(len(y)), 1.0 + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            gradient = y[i] * float(x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - gradient / diagonal, 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def unit(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-9)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, family, sparse counts)."""
    for batch in batches:
        for b in blocks(batch.column(1), BYTES):
            packed = [np.concatenate([np.flatnonzero(r).astype(np.float32), r[r > 0]]).tobytes() for r in gram_counts(b)]
            languages = batch.column(0).slice(b.lo, b.rows)
            yield pa.RecordBatch.from_arrays([languages, pa.array([family_of(x) for x in languages.to_pylist()]), pa.array(packed, pa.binary())], names=["language", "family", "x"])


def dense(packed: pd.Series) -> np.ndarray:
    out = np.zeros((len(packed), WIDTH), np.float32)
    for r, raw in zip(out, packed, strict=True):
        at, n = np.frombuffer(raw, np.float32).reshape(2, -1)
        r[at.astype(int)] = n
    return out


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"kind": ["sum"], "a": [rows["language"].iloc[0]], "b": [rows["family"].iloc[0]], "w": [dense(rows["x"]).sum(axis=0).tobytes()]})


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = rows["a"].iloc[0], rows["b"].iloc[0]
    rows = rows.sort_values(["language", "x"], kind="stable")
    w = train_pair(unit(dense(rows["x"])), np.where(rows["language"] == a, 1.0, -1.0))
    return pd.DataFrame({"kind": ["pair"], "a": [a], "b": [b], "w": [w.tobytes()]})


class Model:
    """Log-probabilities of grams by family, and an SVM for each pair of languages within a family."""

    def __init__(self, rows: list):
        sums = {r["a"]: (r["b"], np.frombuffer(r["w"], np.float32).astype(float)) for r in rows if r["kind"] == "sum"}
        self.languages, self.families = sorted(sums), sorted({f for f, _ in sums.values()})
        self.members = {f: [x for x in self.languages if sums[x][0] == f] for f in self.families}
        counts = np.array([sum(sums[x][1] / max(sums[x][1].sum(), 1) for x in self.members[f]) / len(self.members[f]) for f in self.families]).reshape(-1, WIDTH)
        self.grams = np.log(counts + 1e-6).astype(np.float32)
        self.pairs = {(r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in rows if r["kind"] == "pair"}

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(counts)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        total = counts.sum(axis=1)
        # the evidence of a long text counts as that of 200 grams, so that posteriors stay comparable
        fit = (counts @ self.grams.T) * (np.minimum(total, 200) / np.maximum(total, 1))[:, None]
        posterior = np.exp(fit - fit.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        chosen = posterior.argmax(axis=1)
        names, score = np.empty(n, object), posterior[np.arange(n), chosen].astype(float)
        x = unit(counts)
        for k, f in enumerate(self.families):
            mine, members = np.flatnonzero(chosen == k), self.members[f]
            margins = np.full((len(mine), len(members), len(members)), np.nan, np.float32)
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = x[mine] @ self.pairs[a, members[j]]
                    margins[:, i, j], margins[:, j, i] = m, -m
            wins = (margins > 0).sum(axis=2) + np.tanh(np.nansum(margins, axis=2)) * 0.5
            best = wins.argmax(axis=1)
            names[mine] = np.array(members, object)[best]
            if len(members) > 1:
                weakest = np.nanmin(margins[np.arange(len(mine)), best], axis=1)
                score[mine] *= 1 / (1 + np.exp(-4.0 * weakest))
        score[total == 0] = 1 / len(self.languages)  # a single letter tells nothing
        return names.tolist(), np.clip(score, 0, 1)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the per_language rows of each language that a hash of the key picks (texts without a letter are left out).

    One scan counts the labels of such texts and one takes the sample, which is written down.
    """
    labelled = labelled.select(F.col(key).alias("key"), F.col(language).alias("language"), F.col(text).alias("text"))
    # counted as they are sampled, so that a language of few texts with letters among many without keeps them all
    labelled = labelled.where(F.col("text").rlike("\\p{L}"))
    sample = bounded_sample(labelled, label_counts(labelled, "language"), "key", "language", per_language, "language")
    rows = written(sample.select("language", "text").mapInArrow(features, "language string, family string, x binary"), "languages")
    known = [r[0] for r in rows.select("language").distinct().orderBy("language").collect()]
    pairs = [(a, b) for a in known for b in known if a < b and family_of(a) == family_of(b)]
    out = "kind string, a string, b string, w binary"
    fitted = rows.groupBy("language").applyInPandas(_sums, out)
    if pairs:
        of = rows.sparkSession.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "language string, a string, b string")
        fitted = fitted.unionByName(rows.join(F.broadcast(of), "language").select("a", "b", "language", "x").groupBy("a", "b").applyInPandas(_fit, out))
    return Model(fitted.collect())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1), BYTES):
                names, score = shared.value.predict(gram_counts(b))
                for r in np.flatnonzero(np.diff(b.offsets) == 0):
                    names[r], score[r] = UNDETERMINED, 0.0
                yield pa.RecordBatch.from_arrays([*(c.slice(b.lo, b.rows) for c in batch.columns[:-1]), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    has_letter = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return docs.select(*rest, F.when(has_letter, F.col(text)).otherwise("").alias(unused(docs, "_text"))).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
