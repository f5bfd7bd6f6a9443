"""Harmonic packing of token ids into sequences of one capacity.

A piece of between capacity/(k+1) and capacity/k tokens is of class k: k of them fill a sequence, whatever
their lengths.  Every worker deals its pieces into one open sequence a class and closes it at its k-th piece;
no two workers have to agree on anything.

  1. Cuts.  A document gives whole sequences and a rest.  The rest is left whole where k of its kind fill a
     sequence nearly, or cut into pieces of exactly capacity // k tokens and a last one: a table over all lengths below the
     capacity, made once, holds the cuts that lose the fewest tokens to padding, where a cut counts as CUT tokens.
  2. Filling.  A task closes sequences as it reads, and keeps at most k - 1 pieces of each class, less
     than one sequence a class.  What it has left at its end goes on to the next round.
  3. Further rounds deal the rests of MERGED tasks to one task each, by the same classes, until one task is left: its
     input is the bounded rest of MERGED tasks.  It pours what then remains into sequences
     back to back, cutting at their ends; the last rest is cut at powers of two, which need no padding.

So only rests are shuffled; a sequence that is closed in the first round never moves.

Edge cases: a null or empty text is its end mark alone; a very long text is cut like any other; repeated rows are packed
each; a null id is passed on; an empty table gives no rows; columns other than the key and the text are not read, so their
names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bytelevel
from leafmill.llm.common import table, written
from leafmill.llm.textbytes import blocks

CAPACITY, END_ID = 2048, 1
#: Tokens of padding that one more cut has to save.
CUT = 24
#: The smallest piece that is cut off is capacity // FINEST.
FINEST = 32
#: Tasks whose rests one task of the next round takes.
MERGED = 64
#: Rows of pieces that are handed on together.
ROWS = 1024
#: A sequence's number is round, task and count in the task: 8, 31 and 24 bits.
TASK_BITS, COUNT_BITS = 31, 24


def cut_table(capacity: int = CAPACITY, cut: int = CUT, finest: int = FINEST) -> list[tuple[int, ...]]:
    """The pieces of a rest of each length below the capacity."""
    lengths = np.arange(capacity)
    alone = np.zeros(capacity)
    alone[1:] = capacity / (capacity // lengths[1:]) - lengths[1:]
    bounds = sorted({capacity // k for k in range(2, finest + 1)} - {0})
    best, first = alone.copy(), np.zeros(capacity, np.int64)
    for r in range(1, capacity):
        for b in bounds:
            if b < r and (cost := alone[b] + cut + best[r - b]) < best[r]:
                best[r], first[r] = cost, b
    out: list[tuple[int, ...]] = [()]
    for r in range(1, capacity):
        out.append((int(first[r]), *out[r - first[r]]) if first[r] else (r,))
    return out


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    total: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.ids[:at], self.total), Piece(self.key, self.start + at, self.ids[at:], self.total)


class Filler:
    """One worker: open sequences by class, and closed ones as columns."""

    def __init__(self, capacity: int, round_number: int, worker: int, with_ids: bool):
        self.capacity, self.worker, self.with_ids = capacity, worker, with_ids
        self.next_id = (round_number << TASK_BITS | worker) << COUNT_BITS
        self.open: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        k = self.capacity // len(piece.ids)
        members = self.open.setdefault(k, [])
        members.append(piece)
        if len(members) == k:
            self.close(self.open.pop(k))

    def close(self, members: list[Piece]) -> None:
        offset = 0
        for p in members:
            self.add_row(p, self.next_id, offset, self.with_ids)
            offset += len(p.ids)
        self.next_id += 1

    def add_row(self, p: Piece, sequence: int | None, offset: int, with_ids: bool) -> None:
        raw = np.ascontiguousarray(p.ids, "<u4").tobytes()
        self.rows.append((p.key, p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, offset, raw if with_ids else None, self.worker))

    def rest(self) -> None:
        """Give up the pieces of open sequences as rows without a sequence; offset is their place among them."""
        for place, p in enumerate(p for k in sorted(self.open) for p in self.open[k]):
            self.add_row(p, None, place, True)
        self.open = {}

    def pour(self) -> None:
        """Put the pieces of open sequences back to back, cutting where a sequence ends and the last ones at powers of two."""
        waiting = [p for k in sorted(self.open, reverse=True) for p in self.open[k]]
        self.open, left = {}, sum(len(p.ids) for p in waiting)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            members = []
            while room:
                p = waiting.pop()
                if len(p.ids) > room:
                    p, later = p.split(room)
                    waiting.append(later)
                members.append(p)
                room -= len(p.ids)
            self.close(members)

    def batches(self, schema: pa.Schema, least: int) -> Iterator[pa.RecordBatch]:
        """The rows so far, if there are as many as ``least``."""
        if len(self.rows) >= max(least, 1):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), schema, strict=True)], schema=schema)
            self.rows = []


def pieces_of(key: object, ids: np.ndarray, capacity: int, cuts: list[tuple[int, ...]]) -> Iterator[Piece]:
    at = 0
    for length in [capacity] * (len(ids) // capacity) + list(cuts[len(ids) % capacity]):
        yield Piece(key, at, ids[at : at + length], len(ids))
        at += length


NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "worker")


def _schema(key: str, key_type: pa.DataType) -> pa.Schema:
    return pa.schema([(key, key_type), *((n, pa.binary() if n == "ids" else pa.int64()) for n in NAMES)])


def pack(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit) of every piece.

    model: a byte-level BPE file that the driver can read.  Each document's ids are followed by end_id.  with_ids=False
    leaves ids null, for those who need the plan of the sequences only.  The same rows in the same tasks give the same sequences.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bytelevel.load_model(model, plain_specials=False), cut_table(capacity)))
    columns = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in NAMES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = shared.value
        encoder, filler, schema = model.encoder(), Filler(capacity, 0, TaskContext.get().partitionId(), with_ids), None
        for batch in batches:
            schema = _schema(key, batch.schema.field(0).type)
            for b in blocks(pc.cast(batch.column(1), pa.large_string())):
                ids, rows = encoder.encode(b)
                keys = batch.column(0).slice(b.lo, b.rows).to_pylist()
                for k, lo, hi in zip(keys, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    for piece in pieces_of(k, np.append(ids[lo:hi], end_id), capacity, cuts):
                        filler.add(piece)
                yield from filler.batches(schema, ROWS)
        filler.rest()
        if schema:
            yield from filler.batches(schema, 1)

    def later(round_number: int, last: bool):
        def run(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filler, schema, found = Filler(capacity, round_number, group[0].as_py(), with_ids), None, []
            for batch in batches:  # MERGED tasks' rests: less than a sequence a class and task
                schema = _schema(key, batch.schema.field(1).type)
                found += zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            for k, start, total, ids, _, _ in sorted(found, key=lambda r: r[4:]):
                filler.add(Piece(k, start, np.frombuffer(ids, "<u4"), total))
            filler.pour() if last else filler.rest()
            yield from filler.batches(schema, 1)

        return run

    made = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(first, columns), "pieces")
    most, round_number, closed = (made.agg(F.max("worker")).first()[0] or 0) + 1, 0, []
    while True:
        closed.append(made.where("sequence_id is not null"))
        rest = made.where("sequence_id is null").select(F.expr(f"worker div {MERGED}").alias("_group"), key, "start", "doc_tokens", "ids", "worker", "offset")
        round_number, most = round_number + 1, -(-most // MERGED)
        made = rest.groupBy("_group").applyInArrow(later(round_number, most == 1), columns)
        if most == 1:
            return reduce(DataFrame.unionByName, [*closed, made]).drop("worker")
        made = written(made, "pieces")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id, length, ids (array) and parts (key, start, length of each piece): the sequences themselves, unpadded."""
    part = F.struct("offset", key, "start", "length", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.transform("parts", lambda p: p["ids"]).alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), bytelevel.default_model(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op13_harmonic_packing": op13_harmonic_packing}
ORACLES: dict[str, str] = {}
