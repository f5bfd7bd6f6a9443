"""Alignment of two tokenizers' tokens over the same bytes.

A document is encoded by a byte-level BPE model (A, with a space in front) and by a SentencePiece model (B, which adds
that space itself).  Both sides' tokens cover the same bytes, so:

  * the B tokens' bounds are a static interval index, sorted arrays; two bisections find the B tokens that each A token
    overlaps (its links), for all A tokens of a block at once;
  * a gap between B tokens that no A token spans is a group boundary.

Corpus-wide counts of (A id, B id) pairs come in two passes over blocks of documents.  The first pass
writes the documents' figures, the links as numbers of the block's own pairs, and a dictionary of those pairs with
their counts.  Dictionaries, one row a pair and block, are summed over the corpus; the most frequent A ids of each
B id are marked; counts and marks go back to the blocks that asked, where the second pass, a co-group of a block's
documents and answers, adds them up by document.
So a pair that is in every document is one row a block in any shuffle, and no table of pairs is ever broadcast.

Edge cases: a null or empty text, and one whose tokens' bytes differ from the text (it holds U+2581, or is not
well-formed), has no tokens: all figures are 0 and the digest is empty.  A very long text is a block of its own; repeated
rows are aligned and counted each; null ids are passed on; an empty table gives no rows; columns other than
the key and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bytelevel, pieces
from leafmill.llm.common import table, written
from leafmill.llm.textbytes import Block, blocks, gather_ranges, same_ranges

#: Bytes of text whose pairs share a dictionary.
BLOCK = 1 << 20
#: Blocks of a task have numbers below 2 ** BLOCK_BITS.
BLOCK_BITS = 24
BAR, SEMICOLON = 124, 59
MARK_BYTES = pieces.MARK.encode()


@dataclass
class Side:
    """Tokens of a block: ids, where each begins and ends in the block's bytes, and the first token of each row."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def side(ids: np.ndarray, rows: np.ndarray, entry_bytes: np.ndarray, entry_offsets: np.ndarray) -> tuple[Side, np.ndarray]:
    """The tokens with their places, and their bytes end to end."""
    lengths = entry_offsets[ids + 1] - entry_offsets[ids]
    ends = np.cumsum(lengths)
    return Side(ids.astype(np.int64), ends - lengths, ends, rows), entry_bytes[gather_ranges(entry_offsets[ids], lengths)]


def row_bytes(s: Side) -> np.ndarray:
    """Where each row's bytes begin, and the total."""
    return np.concatenate([[0], s.ends])[s.rows]


def kept(s: Side, rows: np.ndarray) -> Side:
    """Only the tokens of the given rows (booleans); the others become empty."""
    counts = np.where(rows, np.diff(s.rows), 0)
    at = gather_ranges(s.rows[:-1], counts)
    lengths = s.ends[at] - s.starts[at]
    ends = np.cumsum(lengths)
    return Side(s.ids[at], ends - lengths, ends, np.concatenate([[0], np.cumsum(counts)]))


def links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of every overlap, in order; the index over B is its sorted bounds."""
    first = np.searchsorted(b.ends, a.starts, "right")
    count = np.searchsorted(b.starts, a.ends, "left") - first
    return np.repeat(np.arange(len(a.ids)), count), gather_ranges(first, count)


def digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``most`` in decimal, each with a comma, end to end, and offsets."""
    names = [f"{i},".encode() for i in range(most)]
    return np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(n) for n in names])])


def group_strings(a: Side, b: Side, bounds: np.ndarray, numbers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2`` of all rows, each with one sign too many at its end, and row offsets.

    bounds: where groups end, sorted.
    """
    group_a, group_b = np.searchsorted(bounds, a.ends), np.searchsorted(bounds, b.ends)
    upto_a, upto_b = (np.searchsorted(g, np.arange(len(bounds) + 1)) for g in (group_a, group_b))
    place_a = np.arange(len(a.ids)) + upto_b[group_a]
    place_b = np.arange(len(b.ids)) + upto_a[group_b + 1]
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    lengths = numbers[1][ids + 1] - numbers[1][ids]
    ends = np.cumsum(lengths)
    out = numbers[0][gather_ranges(numbers[1][ids], lengths)]
    out[ends[place_a[upto_a[1:] - 1]] - 1] = BAR
    out[ends[place_b[upto_b[1:] - 1]] - 1] = SEMICOLON
    return out, np.concatenate([[0], ends])[a.rows + b.rows]


@dataclass
class Aligned:
    """Figures of a block's rows, and the block's pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    keys: np.ndarray  # the block's pairs, a << 32 | b
    counts: np.ndarray
    row_pairs: np.ndarray  # numbers of pairs by row, distinct in a row
    row_counts: np.ndarray
    row_offsets: np.ndarray


class Aligner:
    def __init__(self, a_model: bytelevel.Model, b_model: pieces.Vocabulary):
        self.a, self.b = a_model.encoder(prefix=True), pieces.Encoder(b_model)
        self.a_bytes, self.b_bytes = bytelevel.token_bytes(a_model), (b_model.piece_bytes, b_model.piece_offsets)
        self.numbers = digits(max(len(self.a_bytes[1]), len(self.b_bytes[1])))

    def align(self, block: Block) -> Aligned:
        filled = np.diff(block.offsets) > 0
        a, a_text = side(*self.a.encode(block), *self.a_bytes)
        marked = np.zeros(block.rows, bool)
        if MARK_BYTES in block.data.tobytes():
            marked[:] = [MARK_BYTES in block.data[x:y].tobytes() for x, y in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
        b, b_text = side(*self.b.encode(block), *self.b_bytes)
        text = np.insert(block.data, block.offsets[:-1], 32)
        at = block.offsets + np.arange(block.rows + 1)
        good = filled & ~marked
        for s, own in ((a, a_text), (b, b_text)):
            begin = row_bytes(s)
            good &= same_ranges(text, at[:-1], at[1:], own, begin[:-1], begin[1:])
        a, b = kept(a, good), kept(b, good)
        from_a, from_b = links(a, b)
        bounds = np.intersect1d(a.ends, b.ends, assume_unique=True)
        n_groups = np.diff(np.searchsorted(bounds, row_bytes(a), "right"))
        shown, upto = group_strings(a, b, bounds, self.numbers) if len(bounds) else (np.zeros(0, np.uint8), np.zeros(block.rows + 1, np.int64))
        raw = shown.tobytes()
        digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        pairs = a.ids[from_a] << 32 | b.ids[from_b]
        keys, code, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        link_rows = np.searchsorted(from_a, a.rows)
        row = np.repeat(np.arange(block.rows), np.diff(link_rows))
        mine, times = np.unique(row * np.int64(max(len(keys), 1)) + code, return_counts=True)
        row_of, number = np.divmod(mine, max(len(keys), 1))
        return Aligned(np.diff(a.rows), np.diff(b.rows), n_groups, np.diff(link_rows), digests, keys, counts, number, times, np.searchsorted(row_of, np.arange(block.rows + 1)))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, a_model: str, b_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row; see the module's text.

    a_model: a byte-level BPE file, b_model: a SentencePiece BPE model, which the driver can read.
    """
    first = written(_aligned(docs, a_model, b_model, key, text), "aligned")
    return _with_counts(first, key)


def pair_counts(first: DataFrame) -> DataFrame:
    """pair, count (links in the corpus), best (whether no A id has more links with this B id) of all pairs of aligned blocks."""
    entries = first.where("keys is not null").select(F.explode(F.arrays_zip("keys", "counts")).alias("e"))
    counts = entries.groupBy(F.col("e.keys").alias("pair")).agg(F.sum("e.counts").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _aligned(docs: DataFrame, a_model: str, b_model: str, key: str, text: str) -> DataFrame:
    """The first pass: a row for each document, and one for each block with its dictionary (keys, counts)."""
    shared = docs.sparkSession.sparkContext.broadcast((bytelevel.load_model(a_model, plain_specials=True), pieces.load_vocabulary(b_model)))
    kind = docs.schema[key].dataType.simpleString()
    columns = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs array<int>, times array<int>, keys array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(*shared.value), TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            for b in blocks(pc.cast(batch.column(1), pa.large_string()), BLOCK):
                x, keys = aligner.align(b), batch.column(0).slice(b.lo, b.rows)
                rows, blank = b.rows + 1, pa.nulls(1, batch.schema.field(0).type)
                last = lambda values, kind: pa.array([*values, None], kind)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([keys, blank]), *(last(getattr(x, n).tolist(), pa.int64()) for n in FIGURES), last(x.digests, pa.string()), pa.array(np.full(rows, number)),
                    pa.concat_arrays([_lists(x.row_pairs, x.row_offsets, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]),
                    pa.concat_arrays([_lists(x.row_counts, x.row_offsets, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]),
                    *(pa.concat_arrays([pa.nulls(b.rows, pa.list_(pa.int64())), _lists(v, np.array([0, len(v)]), pa.int64())]) for v in (x.keys, x.counts)),
                ], names=[key, *FIGURES, "groups_sha256", "block", "pairs", "times", "keys", "counts"])
                number += 1

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, columns)


def _with_counts(first: DataFrame, key: str) -> DataFrame:
    """The second pass: counts and marks go to the blocks that asked, and are added up by document."""
    asked = first.where("keys is not null").select("block", F.posexplode("keys").alias("number", "pair"))
    told = asked.join(pair_counts(first), "pair").select(F.col("block").alias("asked"), "number", "count", "best")
    docs = first.where("keys is null").select(key, *FIGURES, "groups_sha256", "block", "pairs", "times")
    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *FIGURES, "groups_sha256")) + ", n_best long, count_sum long"

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """One block: its documents, and no more answers than it has links."""
        rows = rows.combine_chunks()
        pairs, times = (rows.column(len(FIGURES) + k).combine_chunks() for k in (3, 4))
        offsets = np.asarray(pairs.offsets, np.int64)
        at, number = np.asarray(pairs.values, np.int64), np.asarray(answers.column(1), np.int64)
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        count[number], best[number] = np.asarray(answers.column(2)), np.asarray(answers.column(3))
        weights = np.asarray(times.values, np.int64)
        n_best, total = (np.diff(np.concatenate([[0], np.cumsum(v)])[offsets]) for v in (weights * best[at], weights * count[at]))
        return rows.select(range(len(FIGURES) + 2)).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))

    return docs.groupBy("block").cogroup(told.groupBy("asked")).applyInArrow(add_up, columns)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), bytelevel.default_model(), pieces.default_model())


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
