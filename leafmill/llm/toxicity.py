"""Toxicity by misspelling-tolerant lexicon search with context windows.

Fit: from a bounded sample of labelled texts (LABELLED of each class, near copies thinned out so that
one copied text does not speak for its words) the words and word stems are taken that toxic texts have
and clean ones lack.  They form a trie.  The Levenshtein automaton of distance 1 (a byte inserted, left out or
changed anywhere, the first letter included) runs on the trie's words of FUZZY_FROM letters or more; stems,
after which any ending may follow, are exact.  The intersection of both is made deterministic and becomes
a table of states by byte class.

Bounds of the fit, all parameters here: LABELLED rows of each class, words of up to LONGEST letters, stems of
STEM letters or more (a whole word may be shorter), the PREFIXES commonest beginnings of toxic words, and the
LEXICON best terms of them.  The same rows give the same model however they are partitioned.

Score: the words of a text walk through the table in step, all words of a block at once; most leave it
after two or three letters.  What is left are hits: exact or misspelled words, and stems.  Each hit
looks at its context: a hit between quotation marks or after a word of report counts as quoted, unless
the text addresses somebody close by.  A logistic model with prior weights, fitted on the same sample,
turns the counts of words, misspelled words and stems, abusive and quoted, into a score.

Edge cases: a null or empty text has no hits and gets the score of a text without hits; very long texts
are blocks of their own; repeated rows are scored like any row; without labelled rows the lexicon is
empty and the prior alone speaks; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import bounded_sample, fold, label_counts, table, unused, written
from leafmill.llm.textbytes import Block, Words, blocks, punctuation, range_hashes, shingles, word_hashes, words

#: Labelled texts of each class that the fit uses.
LABELLED = 6000
#: Longest lexicon, and beginnings of words that it is chosen from.
LEXICON, PREFIXES = 1500, 60_000
#: Shortest stem, longest word, and letters from which a word may be misspelled.
STEM, LONGEST, FUZZY_FROM = 4, 40, 5
#: Evidence (G statistic) that a word needs, that a stem needs, of which there are more, and purity.
EVIDENCE, STEM_EVIDENCE, PURITY = 28.0, 42.0, 0.93
#: Bytes before and after a hit that are searched for quotation marks, and words for address and report.
WINDOW, NEAR = 60, 4
THRESHOLD = 0.7

#: Words of report and of address in the languages at hand.
REPORT = "said says say wrote writes called quoted quote quotes reads dit écrit appelé sagte schrieb nannte dijo escribió llamó"
ADDRESS = "you your youre du dich dir dein ihr euch tu toi te ton vous votre tú usted ti vosotros"
#: What a hit can be; stems are rarer proof than whole words, since other words begin with them, too.
WORD, MISSPELLED, STEM_HIT = 1, 2, 3
#: Prior weights: intercept, then words, misspelled words and stems, as abuse and as quotation.
PRIOR, SPREAD = np.array([-4.0, 4.8, 3.5, 3.5, 1.7, 1.2, 1.2]), np.array([1.5, 1.0, 1.0, 1.0, 0.6, 0.6, 0.6])
#: Hits of a kind from which further ones add nothing to the evidence.
SATURATED = 4


class Automaton:
    """Lexicon trie intersected with the Levenshtein automaton, as a table: step[state * classes + class] is the next state.

    State 0 is dead.  accept[state] is 0, or 1 for an exact word or stem, or 2 for a misspelled word.
    """

    def __init__(self, terms: list[tuple[str, bool]], keep_first: bool = True):
        """terms: (word, whether any ending may follow); keep_first: a misspelled word must have the term's first byte."""
        raw = [(t.encode(), open_) for t, open_ in terms]
        used = sorted({c for t, _ in raw for c in t})
        self.classes, self.byte_class = len(used) + 1, np.zeros(256, np.int64)
        for k, c in enumerate(used):
            self.byte_class[c] = k + 1
        children: list[dict[int, int]] = [{}]
        word, stem, fuzzy = [False], [False], [False]
        for t, open_ in raw:
            at, path = 0, [0]
            for c in t:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    word.append(False)
                    stem.append(False)
                    fuzzy.append(False)
                at = children[at][c]
                path.append(at)
            if open_:
                stem[at] = True
            else:
                word[at] = True
                if len(t) >= FUZZY_FROM:
                    for n in path:
                        fuzzy[n] = True
        long = {k for t, open_ in raw if not open_ and len(t) >= FUZZY_FROM for k in [self._find(children, t)]}

        def closed(states: set) -> frozenset:
            """With deletions, and without what a smaller distance covers."""
            out = set(states)
            for n, e in states:
                if e == 0 and fuzzy[n] and (n or not keep_first):
                    out |= {(m, 1) for m in children[n].values() if fuzzy[m]}
            return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

        found = {frozenset(): 0, "hit": 1}
        table, accept, todo = [[0] * self.classes, [1] * self.classes], [0, 1], []

        def number(states: frozenset) -> int:
            if any(e == 0 and stem[n] for n, e in states):
                return 1
            if states not in found:
                found[states] = len(table)
                table.append([0] * self.classes)
                accept.append(1 if any(e == 0 and word[n] for n, e in states) else 2 if any(n in long for n, e in states) else 0)
                todo.append(states)
            return found[states]

        self.start = number(closed({(0, 0)}))
        while todo:
            states = todo.pop()
            row = table[found[states]]
            for k in range(self.classes):
                c, out = used[k - 1] if k else -1, set()
                for n, e in states:
                    if c in children[n] and (e == 0 or fuzzy[children[n][c]]):
                        out.add((children[n][c], e))
                    if e == 0 and fuzzy[n] and (n or not keep_first):
                        out.add((n, 1))
                        out |= {(m, 1) for m in children[n].values() if fuzzy[m]}
                row[k] = number(closed(out))
        self.step, self.accept = np.array(table, np.int32).ravel(), np.array(accept, np.int8)

    @staticmethod
    def _find(children: list[dict[int, int]], t: bytes) -> int:
        at = 0
        for c in t:
            at = children[at][c]
        return at

    def walk(self, data: np.ndarray, w: Words, stem: int = WORD) -> np.ndarray:
        """0, 1 or 2 for every word, and ``stem`` for words that begin with one."""
        accept = self.accept.copy()
        accept[1] = stem
        out, cls = np.zeros(len(w.starts), np.int8), self.byte_class[data]
        live, state, at = np.arange(len(w.starts)), np.full(len(w.starts), self.start), w.starts
        while len(live):
            state = self.step[state * self.classes + cls[at]]
            over = at + 1 == w.ends[live]
            out[live[over]] = accept[state[over]]
            go = ~over & (state != 0)
            live, state, at = live[go], state[go], at[go] + 1
        return out


def _hash_set(listed: str) -> np.ndarray:
    raw = pa.array(listed.split())
    b = next(blocks(raw))
    return np.sort(word_hashes(b.data, Words(b.offsets[:-1], b.offsets[1:], np.arange(b.rows + 1))))


_REPORT, _ADDRESS = _hash_set(REPORT), _hash_set(ADDRESS)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def quote_marks(data: np.ndarray) -> np.ndarray:
    """Positions of quotation marks: the ASCII double one, guillemets and the typographic ones."""
    out = data == 34
    at = np.flatnonzero(data[:-1] == 0xC2)
    out[at[np.isin(data[at + 1], (0xAB, 0xBB))]] = True
    at = np.flatnonzero(data[:-2] == 0xE2)
    out[at[(data[at + 1] == 0x80) & (data[at + 2] >= 0x9C) & (data[at + 2] <= 0x9F)]] = True
    return out


def hit_counts(automaton: Automaton, block: Block) -> np.ndarray:
    """Counts of words, misspelled words and stems as abuse, then as quotation, by row, of lower-case texts."""
    w = words(block, punctuation(block.data))
    found = automaton.walk(block.data, w, STEM_HIT)
    hits = np.flatnonzero(found)
    out = np.zeros((block.rows, 6))
    if not len(hits):
        return out
    row = np.searchsorted(w.rows, hits, "right") - 1
    lo, hi = block.offsets[row], block.offsets[row + 1]
    marks = np.concatenate([[0], np.cumsum(quote_marks(block.data))])
    start, end = w.starts[hits], w.ends[hits]
    left = marks[start] - marks[np.maximum(start - WINDOW, lo)]
    right = marks[np.minimum(end + WINDOW, hi)] - marks[end]
    report, address = np.zeros(len(hits), bool), np.zeros(len(hits), bool)
    for d in [*range(-NEAR, 0), *range(1, NEAR + 1)]:
        near = hits + d
        inside = (near >= w.rows[row]) & (near < w.rows[row + 1])
        near = np.where(inside, near, hits)
        h = range_hashes(block.data, w.starts[near], w.ends[near])
        address |= inside & _among(h, _ADDRESS)
        report |= inside & _among(h, _REPORT) & (d < 0)
    score = np.minimum(left, 1) + np.minimum(right, 1) + report - 2 * address
    quoted = score >= 2
    np.add.at(out, (row, quoted * 3 + found[hits] - 1), 1)
    return out


def sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, lower text) to (key, label, text, words, k0, k1, k2): the distinct words and three MinHash values of the text."""
    for batch in batches:
        for b in blocks(batch.column(2)):
            w = words(b, punctuation(b.data))
            sh, rows = shingles(word_hashes(b.data, w), w.rows, 5)
            listed, keys = [], np.zeros((b.rows, 3), np.uint64)
            for r in range(b.rows):
                listed.append(sorted({b.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts[w.rows[r] : w.rows[r + 1]], w.ends[w.rows[r] : w.rows[r + 1]], strict=True)}))
                for k, f in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    keys[r, k] = (sh[rows[r] : rows[r + 1]] * np.uint64(f)).min(initial=2**64 - 1)
            yield pa.RecordBatch.from_arrays([*(c.slice(b.lo, b.rows) for c in batch.columns), pa.array(listed, pa.list_(pa.string())), *(pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in range(3))], names=["key", "label", "text", "words", "k0", "k1", "k2"])


def choose_lexicon(prefixes: list, toxic: int, clean: int) -> list[tuple[str, bool]]:
    """Words and stems from the (prefix, toxic, clean, whole) counts of pure prefixes.

    The shortest pure prefix counts; it is lengthened while one continuation has nearly all of its
    texts; it is a word if the word alone has most of them, and a stem of many words otherwise.
    """
    count = {r["prefix"]: (r["toxic"], r["clean"], r["whole"]) for r in prefixes}
    good = {}
    total = toxic + clean
    for p, (t, c, _) in count.items():
        expected = ((t + c) * toxic / total, (t + c) * clean / total)
        g = 2 * sum(o * np.log(o / e) for o, e in zip((t, c), expected, strict=True) if o)
        share = (t / toxic) / (t / toxic + (c + 0.5) / clean)
        if g >= EVIDENCE and share >= PURITY:
            good[p] = (t, g)
    longer = defaultdict(list)
    for p in count:
        longer[p[:-1]].append(p)
    out = {}
    for p in good:
        if any(p[:k] in good for k in range(STEM, len(p))):
            continue
        end = p
        while True:
            further = [q for q in longer[end] if count[q][0] >= 0.9 * count[end][0]]
            if not further or count[end][2] >= 0.5 * count[end][0]:
                break
            end = further[0]
        open_ = count[end][2] < 0.5 * count[end][0]
        if not open_ or good[p][1] >= STEM_EVIDENCE:
            out[end, open_] = good[p][0]
    return [k for k, _ in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]]


def evidence(counts: np.ndarray) -> np.ndarray:
    """What the logistic model sees of the counts of hits."""
    return np.minimum(counts, SATURATED)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Maximum a posteriori weights under independent normal priors, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), evidence(x)])
    beta = PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - (beta - PRIOR) / SPREAD**2
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(1 / SPREAD**2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step / max(1.0, np.abs(step).max())
    return beta


class Model:
    def __init__(self, terms: list[tuple[str, bool]], beta: np.ndarray):
        self.terms, self.beta, self.automaton = terms, beta, Automaton(terms, keep_first=False)

    def score(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        counts = hit_counts(self.automaton, block)
        return 1 / (1 + np.exp(-(self.beta[0] + evidence(counts) @ self.beta[1:]))), counts


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """labels: key and label of the rows to learn from."""
    labels = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label"))
    totals = label_counts(labels, "label")
    chosen = bounded_sample(labels, totals, key, "label", LABELLED, "toxicity")
    # LABELLED keys of each class at most
    rows = docs.join(F.broadcast(chosen), key).select(F.col(key).cast("string").alias("key"), "label", F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    rows = rows.mapInArrow(sample_words, "key string, label int, text string, words array<string>, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):  # of texts that share a sample, the one with the first key stays
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(k).orderBy("key", "text", "label"))).where("_rank = 1").drop("_rank")
    rows = written(rows, "labelled")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model([], PRIOR)
    token = rows.select("label", F.explode("words").alias("word")).where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    starts = F.explode(F.transform(F.sequence(F.least(F.lit(STEM), F.char_length("word")), F.char_length("word")), lambda n: F.col("word").substr(F.lit(1), n)))
    prefix = token.select("word", "toxic", "clean", starts.alias("prefix")).groupBy("prefix")
    prefix = prefix.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum(F.when(F.col("word") == F.col("prefix"), F.col("toxic")).otherwise(0)).alias("whole"))
    prefix = prefix.where((F.col("toxic") >= 5) & (F.col("toxic") * sizes[0] > 10 * F.col("clean") * sizes[1])).orderBy(F.desc("toxic"), "prefix").limit(PREFIXES)
    terms = choose_lexicon(prefix.collect(), sizes[1], sizes[0])
    automaton = Automaton(terms, keep_first=False)

    counts = [f"n{k}" for k in range(6)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.rows), *(pa.array(c) for c in hit_counts(automaton, b).T)], names=["label", *counts])

    seen = np.array([tuple(r) for r in rows.select("label", "text").mapInArrow(counted, ", ".join(["label int", *(f"{c} double" for c in counts)])).orderBy("label", *counts).collect()], float)
    y = seen[:, 0]
    weight = np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    return Model(terms, fit_logistic(seen[:, 1:], y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with score, predicted and the number of hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"score": T.DoubleType(), "predicted": T.IntegerType(), "abusive_hits": T.LongType(), "quoted_hits": T.LongType()}
    rest = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, t) for c, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                p, n = shared.value.score(b)
                out = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), *(pa.array(n[:, k : k + 3].sum(axis=1).astype(np.int64)) for k in (0, 3))]
                yield pa.RecordBatch.from_arrays([*(c.slice(b.lo, b.rows) for c in batch.columns[:-1]), *out], names=schema.names)

    return docs.select(*rest, F.lower(text).alias(unused(docs, "_text"))).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 1).select("doc_id", "toxic"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted", "abusive_hits", "quoted_hits")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
