"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

Terms are word n-grams.  A test item is cut into entries of up to ENTRY n-grams, of equal length within an item, and
indexed: each posting carries the entry's BM25 impact of the term, divided by the score that the entry gives itself, so
a score is the share of an entry that a text covers.  An entry is retrieved from MIN_SCORE on, or from less where
that could miss half of its n-grams: any half of them weighs at least as much as the lightest half.  Entries lie in
blocks; a term's largest impact in a block bounds what the block can add.

Every passage of a training text is a query, and the passages' scores are added up by text before the threshold, so it does
not matter how far apart the pieces of an item lie.  A text whose sum of overall maxima stays below the least
threshold is out; of the others, only blocks whose sum of block maxima reaches the block's least threshold are opened:
the postings of the other blocks are not read.  All entries that reach theirs are retrieved.  A text that holds
MIN_OVERLAP of an item's n-grams holds as much of one of its entries, so none is missed.  Entries serve retrieval
only.  The item of a retrieved entry is then verified: the shares of the question's and of the answer's word n-grams that
the text holds are computed, over all entries of the item, and the text is a leak where the item as a whole is held to
MIN_OVERLAP or more.  Question and answer are verified apart: ``verified`` names the part (or both) that is held to
MIN_OVERLAP by itself, and is ``parts`` where only the item as a whole is.  The answer is the last sentence of an item,
or its last quarter.

Words are hashed under a key that is drawn for each index, so no text can be written to look like an item.

The index is built by executors, a shard of whole items in a task, from document frequencies counted over
all items, and written to the shared folder.  It is loaded and broadcast in groups of about GROUP_POSTINGS
postings, one group at a time in the driver's memory; a larger benchmark takes several passes over the texts, in
blocks.  Training texts are never shuffled.

Edge cases: a null or empty text, or an item without words, matches nothing; an item with a null id is an item
like any other, and ids may have any type; items of fewer than n words
use shorter n-grams; repeated items or texts are matched one by one; empty tables give no rows; very long
texts are blocks of their own; extra columns are passed on by ``kept_rows`` and ignored by ``leaks``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import table, unused, written
from leafmill.llm.textbytes import Block, Words, blocks, gather_ranges, new_key, punctuation, shingles, word_hashes, words

K1, B = 1.2, 0.75
#: N-grams of an entry.
ENTRY = 128
#: Share of an entry's own score from which it is retrieved at the latest, n-gram size, and share of n-grams of a leak.
MIN_SCORE, GRAM, MIN_OVERLAP = 0.3, 5, 0.5
#: Entries of a block and of a shard, and postings of what is broadcast at once.
BLOCK_ENTRIES, SHARD_ENTRIES, GROUP_POSTINGS = 8, 256, 2_000_000


@dataclass
class Shard:
    """Up to SHARD_ENTRIES entries: postings by term, block maxima, and what verification needs."""

    terms: np.ndarray  # sorted
    most: np.ndarray  # largest impact of a term anywhere
    first: np.ndarray  # postings of term t are first[t] to first[t+1]
    met: np.ndarray  # the blocks in which it occurs are numbers met[t] to met[t+1] of the next three
    block: np.ndarray
    block_most: np.ndarray  # its largest impact there
    block_first: np.ndarray  # its first posting there; those of the next number follow
    entry: np.ndarray
    impact: np.ndarray
    need: np.ndarray  # score from which an entry is retrieved
    block_need: np.ndarray  # the least of a block
    items: list  # item of an entry
    unit: np.ndarray  # number of an entry's item, by which the n-grams below are listed
    wholes: list[np.ndarray]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    sizes: list[int]


def tokens(block: Block, key: int) -> tuple[Words, np.ndarray]:
    w = words(block, punctuation(block.data))
    return w, word_hashes(block.data, w, key)


def lower_blocks(column: pa.Array, rows: int = 2000) -> Iterator[Block]:
    """Blocks of the lower-case texts of a column, a few rows at a time; lo and hi count from the column's start."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        try:
            lower = pc.utf8_lower(part)
        except pa.ArrowInvalid:  # bytes that are no text
            lower = pa.array([(x.as_buffer().to_pybytes() if x.is_valid else b"").decode("utf-8", "replace").lower() for x in part], pa.string())
        for b in blocks(lower):
            yield Block(b.lo + at, b.hi + at, b.data, b.offsets)


def entry_rows(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, text) to (item, whole, part, size, own, terms, answer_from) with the n-grams' hashes in order; whole tells texts of one item id apart, own counts n-grams that no earlier part has."""
        for batch in batches:
            out: dict[str, list] = {"item": [], "whole": [], "part": [], "size": [], "own": [], "terms": [], "answer_from": []}
            for b in lower_blocks(batch.column(1)):
                w, h = tokens(b, key)
                text = b.data
                for r in range(b.rows):
                    i, j = w.rows[r], w.rows[r + 1]
                    if i == j:
                        continue
                    # a sentence ends where a full stop, question mark or exclamation mark follows a word
                    ends = [k + 1 for k in range(i, j - 1) if np.isin(text[w.ends[k] : w.starts[k + 1]], [33, 46, 63]).any()]
                    size = min(GRAM, j - i)
                    answer = max((ends[-1] if ends else j - max(1, (j - i) // 4)) - i - size + 1, 0)  # n-grams of the question
                    whole = int.from_bytes(hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest(), "little", signed=True)
                    terms = shingles(h[i:j], np.array([0, j - i]), size)[0]
                    new = np.zeros(len(terms), bool)
                    new[np.unique(terms, return_index=True)[1]] = True
                    parts = -(-len(terms) // ENTRY)
                    for part in range(parts):
                        lo, hi = part * len(terms) // parts, (part + 1) * len(terms) // parts
                        out["item"].append(batch.column(0)[b.lo + r].as_py())
                        out["whole"].append(whole)
                        out["part"].append(part)
                        out["size"].append(int(size))
                        out["own"].append(int(new[lo:hi].sum()))
                        out["terms"].append(terms[lo:hi].view(np.int64).tolist())
                        out["answer_from"].append(int(min(max(answer - lo, 0), hi - lo)))
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], batch.column(0).type), pa.array(out["whole"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("part", "size", "own")), pa.array(out["terms"], pa.list_(pa.int64())), pa.array(out["answer_from"], pa.int32())], names=list(out))

    return run


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(hashes, np.array([0, len(hashes)]), size)[0])


def build_shard(rows: list, frequency: dict[int, int], n: int, average: float) -> Shard:
    """Index the entries of a few items; frequency and average come from all of them."""
    rows = sorted(rows, key=lambda r: (sorted(set(r["terms"]), key=lambda t: (-frequency[t], t))[:3], str(r["item"]), r.get("whole", 0), r["part"]))
    units: dict[tuple[int, int], int] = {}
    unit = np.array([units.setdefault((r["item"], r.get("whole", 0)), len(units)) for r in rows])
    entry, term, impact, need = [], [], [], []
    for e, r in enumerate(rows):
        t, tf = np.unique(np.array(r["terms"], np.int64), return_counts=True)
        df = np.array([frequency[x] for x in t.tolist()])
        weight = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r["terms"]) / average))
        entry.append(np.full(len(t), e))
        term.append(t.view(np.uint64))
        impact.append(weight / weight.sum())
        half = int(-(-(r.get("own") or len(t)) * MIN_OVERLAP // 1))
        need.append(min(MIN_SCORE, np.sort(impact[-1])[:half].sum()))
    entry, term, impact = np.concatenate(entry), np.concatenate(term), np.concatenate(impact).astype(np.float32)
    order = np.argsort(term, kind="stable")
    entry, term, impact = entry[order], term[order], impact[order]
    terms, first = np.unique(term, return_index=True)
    number = np.searchsorted(terms, term)
    need = np.array(need)
    block_need = np.minimum.reduceat(need, np.arange(0, len(need), BLOCK_ENTRIES))
    blocks_ = -(-len(rows) // BLOCK_ENTRIES)
    met, block_first = np.unique(number * blocks_ + entry // BLOCK_ENTRIES, return_index=True)
    block_most = np.maximum.reduceat(impact, block_first)
    by_term = np.searchsorted(met, np.arange(len(terms) + 1) * blocks_)
    most = np.maximum.reduceat(impact, first)
    q, a, sizes = [[] for _ in units], [[] for _ in units], [GRAM] * len(units)
    for u, r in zip(unit, rows, strict=True):
        every = np.array(r["terms"], np.int64).view(np.uint64)
        q[u].append(every[: r["answer_from"]])
        a[u].append(every[r["answer_from"] :])
        sizes[u] = r.get("size", GRAM)
    q, a = ([np.unique(np.concatenate(x)) for x in listed] for listed in (q, a))
    return Shard(terms, most, np.append(first, len(term)), by_term, met % blocks_, block_most, np.append(block_first, len(term)), entry, impact, need, block_need, [r["item"] for r in rows], unit, [np.union1d(x, y) for x, y in zip(q, a, strict=True)], q, a, sizes)


def packed_shard(n: int, average: float):
    def run(entries: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The entries of one shard and the frequencies of their terms to the shard's index."""
        rows = entries.astype(object).where(entries.notna(), None).to_dict("records")
        if not rows:
            return pd.DataFrame({"shard": pd.Series(dtype="int64"), "postings": pd.Series(dtype="int64"), "index": pd.Series(dtype=object)})
        shard = build_shard(rows, dict(zip(known["term"].tolist(), known["df"].tolist(), strict=True)), n, average)
        return pd.DataFrame({"shard": [int(rows[0]["shard"])], "postings": [len(shard.entry)], "index": [pickle.dumps(shard, protocol=5)]})

    return run


class Index:
    """The shards of a benchmark, in the shared folder; groups() brings them to the driver a group at a time."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text"):
        self.item_type, self.key = benchmark.schema[item].dataType, new_key()
        benchmark = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
        schema = f"item {self.item_type.simpleString()}, whole long, part int, size int, own int, terms array<long>, answer_from int"
        entries = written(benchmark.mapInArrow(entry_rows(self.key), schema), "entries")
        n, average = entries.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
        self.stored, self.sizes = None, []
        if not n:
            return
        placed = entries.withColumn("shard", F.pmod(F.xxhash64("item", "whole"), F.lit(-(-n // SHARD_ENTRIES))))
        terms = placed.select("shard", F.explode(F.array_distinct("terms")).alias("term"))
        known = terms.distinct().join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
        both = placed.groupBy("shard").cogroup(known.select(F.col("shard").alias("of"), "term", "df").groupBy("of"))
        self.stored = written(both.applyInPandas(packed_shard(n, average), "shard long, postings long, index binary"), "index", maxRecordsPerFile=16)
        self.sizes = [(r["shard"], r["postings"]) for r in self.stored.select("shard", "postings").orderBy("shard").collect()]

    def groups(self) -> Iterator[list[bytes]]:
        """Groups of shards, packed, each small enough to broadcast; a benchmark of usual size is one group."""
        mine, held = [], 0
        for k, (shard, postings) in enumerate(self.sizes):
            mine.append(shard)
            held += postings
            if k + 1 == len(self.sizes) or held + self.sizes[k + 1][1] > GROUP_POSTINGS:
                yield [bytes(r["index"]) for r in self.stored.where(F.col("shard").between(mine[0], mine[-1])).orderBy("shard").select("index").collect()]
                mine, held = [], 0


def retrieve(s: Shard, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, entry and score of every pair that reaches what the entry needs; query q has the terms start[q] to end[q]."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(s.terms, hashes), len(s.terms) - 1)
    term = np.where(s.terms[at] == hashes, at, -1)
    known = np.flatnonzero(term >= 0)
    lo, hi = np.searchsorted(known, start), np.searchsorted(known, end)
    # sums with repetitions bound sums over distinct terms, and cost no sorting
    rough = np.concatenate([[0], np.cumsum(s.most[term[known]], dtype=float)])
    live = np.flatnonzero(rough[hi] - rough[lo] >= s.need.min() - 1e-6)
    if not len(live):
        return none
    lengths = hi[live] - lo[live]
    key = np.unique(np.repeat(live, lengths) * len(s.terms) + term[known[gather_ranges(lo[live], lengths)]])
    passage, t = key // len(s.terms), key % len(s.terms)
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    bound = np.add.reduceat(s.most[t], first)
    alive = np.repeat(bound >= s.need.min() - 1e-4, np.diff(np.append(first, len(t))))
    passage, t = passage[alive], t[alive]
    if not len(t):
        return none
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    many = s.met[t + 1] - s.met[t]
    pair, of, width = gather_ranges(s.met[t], many), np.repeat(np.arange(len(t)), many), len(s.block_need)
    place = group[of] * width + s.block[pair]
    bounds = np.bincount(place, s.block_most[pair], len(first) * width)
    opened = bounds[place] >= s.block_need[s.block[pair]] - 1e-4
    if not opened.any():
        return none
    pair, of = pair[opened], of[opened]
    lo, hi = s.block_first[pair], s.block_first[pair + 1]
    posting = gather_ranges(lo, hi - lo)
    key, which = np.unique(np.repeat(passage[of], hi - lo) * len(s.items) + s.entry[posting], return_inverse=True)
    score = np.bincount(which, s.impact[posting], len(key))
    good = score >= s.need[key % len(s.items)] - 1e-6
    return key[good] // len(s.items), key[good] % len(s.items), score[good]


def held(some: np.ndarray, here: np.ndarray) -> float:
    """Share of n-grams that a sorted array has; 0 without any."""
    if not len(some) or not len(here):
        return 0.0
    return float((here[np.minimum(np.searchsorted(here, some), len(here) - 1)] == some).mean())


@dataclass
class Loaded:
    """A group of shards as a task holds it, with all their terms by n-gram size: a text without any is out at once."""

    key: int
    shards: list[Shard]
    terms: dict[int, np.ndarray]

    @classmethod
    def of(cls, key: int, packed: list[bytes]) -> Loaded:
        shards = [pickle.loads(x) for x in packed]
        sizes = sorted({k for s in shards for k in s.sizes})
        return cls(key, shards, {k: np.unique(np.concatenate([w for s in shards for w, own in zip(s.wholes, s.sizes, strict=True) if own == k])) for k in sizes})


def known_terms(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(terms[np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)] == hashes)


def found_in(block: Block, group: Loaded) -> dict[tuple[int, object], tuple[float, float, float, float]]:
    """(row, item) to (best score, overlap, question's, answer's) of each leak in a block of lower-case texts."""
    w, words_of = tokens(block, group.key)
    out: dict[tuple[int, object], tuple[float, float, float, float]] = {}
    for size, terms in group.terms.items():
        hashes, rows = shingles(words_of, w.rows, size)
        at = known_terms(terms, hashes)
        if not len(at):
            continue
        hashes, bounds = hashes[at], np.searchsorted(at, rows)
        # equal n-grams of a text are one term, and passages that share them add it once
        row = np.flatnonzero(np.diff(bounds))
        texts: dict[int, np.ndarray] = {}
        for s in group.shards:
            met: dict[tuple[int, int], tuple[float, object]] = {}
            for p, e, score in zip(*retrieve(s, hashes, bounds[row], bounds[row + 1]), strict=True):
                if s.sizes[s.unit[e]] == size:
                    k = int(row[p]), int(s.unit[e])
                    met[k] = max(met.get(k, (0.0, None)), (float(score), s.items[e]), key=lambda x: x[0])
            for (r, u), (score, item) in met.items():
                if r not in texts:
                    texts[r] = np.unique(hashes[bounds[r] : bounds[r + 1]])
                share = held(s.wholes[u], texts[r])
                if share >= MIN_OVERLAP:
                    k = r, item
                    out[k] = max(out.get(k, (0.0,) * 4), (score, share, held(s.questions[u], texts[r]), held(s.answers[u], texts[r])), key=lambda x: (x[1], x))
    return out


def verified(question: float, answer: float) -> str:
    found = [name for name, share in (("question", question), ("answer", answer)) if share >= MIN_OVERLAP]
    return " and ".join(found) or "parts"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text and test item that it holds: key, item_id, score, overlap, question_overlap, answer_overlap, verified."""
    spark, index = docs.sparkSession, Index(benchmark)
    numbers = ("score", "overlap", "question_overlap", "answer_overlap")
    schema = T.StructType([docs.schema[key], T.StructField("item_id", index.item_type), *(T.StructField(c, T.DoubleType()) for c in numbers), T.StructField("verified", T.StringType())])
    item_type = to_arrow_type(index.item_type)
    result = None
    for group in index.groups():
        shared = spark.sparkContext.broadcast((index.key, group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = Loaded.of(*shared.value)
            for batch in batches:
                for b in lower_blocks(batch.column(1)):
                    if hits := found_in(b, loaded):
                        keys = batch.column(0).take(pa.array([b.lo + r for r, _ in hits]))
                        found = np.array(list(hits.values()))
                        yield pa.RecordBatch.from_arrays([keys, pa.array([i for _, i in hits], item_type), *(pa.array(found[:, k]) for k in range(4)), pa.array([verified(*x) for x in found[:, 2:]])], names=schema.names)

        part = docs.select(key, F.col(text).alias(unused(docs, "_text"))).mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], schema)
    # repeated texts, and items that share an id, give one row: the one that holds most
    most = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap", "verified")).alias("most")
    return result.groupBy(key, "item_id").agg(most).select(key, "item_id", *(F.col(f"most.{c}").alias(c) for c in (*numbers, "verified")))


def kept_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the texts that hold a test item, decided inside the scan."""
    place = docs.columns.index(text)
    index = Index(benchmark)
    for group in index.groups():
        shared = docs.sparkSession.sparkContext.broadcast((index.key, group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = Loaded.of(*shared.value)
            for batch in batches:
                for b in lower_blocks(batch.column(place)):
                    keep = np.ones(b.rows, bool)
                    keep[[r for r, _ in found_in(b, loaded)]] = False
                    yield batch.slice(b.lo, b.rows).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_bm25_decontamination": op8_bm25_decontamination}
ORACLES: dict[str, str] = {}
