"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can cross (above all before the mark of a space), so
the merges of one segment never meet those of another.  The distinct segments of a block are merged
together in flat arrays: every round takes the smallest pair rank of each segment and merges all its
occurrences there at once, of overlapping ones the leftmost; worn arrays are compacted, until no pair
remains.  Where a merge makes a pair that the sequential algorithm would take before the next occurrence
(its rank is not above the one just merged), the segment merges its first occurrence only in that round,
so the result is the library's.  A segment takes as many rounds as it has ranks, not merges, so the same
rounds serve segments of any length.  Characters outside the vocabulary become byte pieces.

Decoding is a gather of piece bytes by id.

Edge cases: a null or empty text has no ids and decodes to the empty text; very long texts are blocks
of their own; repeated rows are encoded like any row; an empty table gives no rows; other columns are
passed on by ``encode`` unless they clash with a result column, in which case the result column wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import table, unused
from leafmill.llm.textbytes import Block, blocks, gather_ranges, range_hashes, same_ranges

MARK = "▁"
#: Distinct segments, and their bytes, that a task remembers; beyond it they are merged again.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
#: Rank of a pair that is no piece.
NONE = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Tables of a BPE model with byte fallback; their size follows from the vocabulary alone."""

    size: int
    chars: np.ndarray  # code points that occur in pieces, sorted
    char_symbols: np.ndarray  # their symbols
    pairs: np.ndarray  # left * base + right, sorted
    pair_ranks: np.ndarray
    pair_symbols: np.ndarray
    base: int
    byte_ids: np.ndarray
    piece_bytes: np.ndarray  # bytes of all pieces, end to end
    piece_offsets: np.ndarray
    cuts: np.ndarray  # [previous byte * 256 + byte]: a segment may begin here
    add_prefix: bool


def refuse_others(path: str) -> None:
    """Raise on models that this module would encode otherwise than the library."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    faults = {
        "it is no BPE model": trainer.model_type != proto.TrainerSpec.BPE, "it has no byte fallback": not trainer.byte_fallback, "it normalises texts": bool(normalizer.precompiled_charsmap),
        "it removes or keeps spaces otherwise": normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces or trainer.treat_whitespace_as_suffix,
        "it has pieces of the user's own or unused ones": bool(kinds & {proto.ModelProto.SentencePiece.USER_DEFINED, proto.ModelProto.SentencePiece.UNUSED}),
    }
    if found := [what for what, wrong in faults.items() if wrong]:
        raise ValueError(f"{path} is not supported: {'; '.join(found)}")


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece BPE model; its vocabulary is used, the encoding is ours."""
    import sentencepiece

    refuse_others(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
    names = [sp.id_to_piece(i) for i in range(n)]
    symbols = {p: i for i, p in enumerate(names) if not special[i]}
    raw = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    known = dict(symbols)
    for p in symbols:
        for c in p:
            known.setdefault(c, len(known) + n)
    ranks = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in symbols.values()}))}
    base = n + len(known)
    found = [(known[p[:k]] * base + known[p[k:]], ranks[-sp.get_score(i)], i) for p, i in symbols.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    found.sort()
    chars = sorted(ord(c) for c in known if len(c) == 1)
    within = {(a, b) for p in symbols for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:], strict=False)}
    plain = {c for p in symbols for c in p.replace(MARK, " ")}
    cuts = np.zeros((256, 256), bool)
    for a in range(128):
        for b in range(128):
            cuts[a, b] = (chr(a), chr(b)) not in within
        if chr(a) not in plain:  # it becomes a byte piece, whatever stands beside it
            cuts[a, :] = True
            cuts[:, a] = True
    cuts[128:, 32] = not any(b == " " for a, b in within if ord(a) > 127)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return Vocabulary(
        n, np.array(chars), np.array([known[chr(c)] for c in chars]), *(np.array([f[k] for f in found]) for k in range(3)), base,
        np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]), np.frombuffer(b"".join(raw), np.uint8), offsets, cuts.reshape(-1), sp.id_to_piece(sp.encode("a")[0]).startswith(MARK),
    )


def pair_lookup(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and symbol of each pair; NONE and 0 where it is no piece."""
    key = left * v.base + right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    known = (v.pairs[at] == key) & (left < v.base) & (right < v.base)
    return np.where(known, v.pair_ranks[at], NONE), np.where(known, v.pair_symbols[at], 0)


class Rounds:
    """Words under merge as flat arrays: symbols, links to the neighbours, and rank and product of the pair that begins at each symbol.

    A merged symbol stays where its left part was and its right part is dead (rank NONE, no links to it) until
    the next compaction.  Place n is a sentinel: the neighbour of a word's ends.
    """

    def __init__(self, v: Vocabulary, symbols: np.ndarray, owner: np.ndarray):
        self.v, self.n, self.owner = v, len(symbols), owner
        self.symbols = np.append(symbols, v.base)
        self.alive = np.ones(self.n, bool)
        edge = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        self.first = np.concatenate([[0], edge])
        self.sizes = np.diff(np.append(self.first, self.n))
        self.word = np.repeat(np.arange(len(self.first)), self.sizes)
        self.after, self.before = np.arange(1, self.n + 2), np.arange(-1, self.n)
        self.after[self.first[1:] - 1] = self.after[self.n] = self.n
        self.before[self.first] = self.before[self.n] = self.n
        self.rank, self.product = pair_lookup(v, self.symbols, self.symbols[self.after])

    def neighbours(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places left and right of the merged pairs, and rank and product of the pairs that they then make with the product."""
        dead, made = self.after[hit], self.product[hit]
        left, right = self.before[hit], self.after[dead]
        second, head = np.zeros(self.n + 1, bool), np.zeros(self.n + 1, bool)
        second[dead], head[hit] = True, True
        beside = np.where(second[left], self.product[self.before[left]], self.symbols[left])
        at = np.where(second[left], self.before[left], left)
        beyond = np.where(head[right], self.product[right], self.symbols[right])
        touching = np.flatnonzero(head[right])
        # before the right neighbour is merged, too, its first symbol stands beside the product
        between = np.full(len(hit), NONE)
        between[touching] = pair_lookup(self.v, made[touching], self.symbols[right[touching]])[0]
        return at, *pair_lookup(self.v, beside, made), *pair_lookup(self.v, made, beyond), between

    def step(self) -> bool:
        """One round over all words; False when no pair remains."""
        low = np.minimum.reduceat(self.rank[: self.n], self.first)
        if (low == NONE).all():
            return False
        hit = np.flatnonzero(self.rank[: self.n] == np.repeat(np.where(low == NONE, -1, low), self.sizes))
        # of overlapping occurrences, every other one from the left
        place, joined = np.arange(len(hit)), np.zeros(len(hit), bool)
        joined[1:] = self.after[hit[:-1]] == hit[1:]
        hit = hit[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
        at, left, left_made, right, right_made, between = self.neighbours(hit)
        mine = self.word[hit]
        early = np.minimum(np.minimum(left, right), between) <= low[mine]
        if early.any():  # a product's own pair comes before the next occurrence: such words merge their first one only
            held = np.zeros(len(low), bool)
            held[mine[early]] = True
            begins = np.ones(len(hit), bool)
            begins[1:] = mine[1:] != mine[:-1]
            hit = hit[begins | ~held[mine]]
            at, left, left_made, right, right_made, _ = self.neighbours(hit)
        dead = self.after[hit]
        self.symbols[hit], self.alive[dead], self.rank[dead] = self.product[hit], False, NONE
        beyond = self.after[dead]
        self.after[hit], self.before[beyond] = beyond, hit
        self.rank[hit], self.product[hit] = right, right_made
        self.rank[at], self.product[at] = left, left_made
        self.rank[self.n], self.before[self.n] = NONE, self.n
        return True

    def worn(self) -> bool:
        """Whether a third of the symbols is dead."""
        return 3 * np.count_nonzero(self.alive) < 2 * self.n

    def compact(self) -> tuple[np.ndarray, np.ndarray, Rounds | None]:
        """Symbols and owners of finished words, and the others without their dead symbols."""
        low = np.minimum.reduceat(self.rank[: self.n], self.first)
        over = np.repeat(low == NONE, self.sizes)
        done, live = self.alive & over, self.alive & ~over
        rest = Rounds(self.v, self.symbols[:-1][live], self.owner[live]) if live.any() else None
        return self.symbols[:-1][done], self.owner[done], rest


def merge_rounds(v: Vocabulary, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all segments, which are runs of equal, rising ``segment`` numbers; returns the same arrays, compacted."""
    done, state = [], Rounds(v, symbols, segment) if len(symbols) else None
    while state is not None:
        if not state.step() or state.worn():
            *finished, state = state.compact()
            done.append(finished)
    if not done:
        return symbols, segment
    symbols, segment = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(segment, kind="stable")
    return symbols[order], segment[order]


def encode_segments(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given segments end to end, and their offsets."""
    lengths = ends - starts
    flat = data[gather_ranges(starts, lengths)]
    lead = (flat & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    sizes = np.diff(np.concatenate([[0], np.cumsum(lead)])[bounds])
    text = flat.tobytes().decode("utf-8", "replace")
    if len(text) != sizes.sum():  # not well-formed
        parts = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        text, sizes = "".join(parts), np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer(text.replace(" ", MARK).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(v.chars, points), len(v.chars) - 1)
    symbols = np.where(v.chars[at] == points, v.char_symbols[at], v.base + points)
    segment = np.repeat(np.arange(len(starts)), sizes)
    symbols, segment = merge_rounds(v, symbols, segment)
    if (strange := symbols >= v.size).any():  # characters outside the vocabulary: their bytes
        back = np.zeros(v.base, np.int64)
        back[v.char_symbols] = v.chars
        codes = np.where(symbols >= v.base, symbols - v.base, back[np.minimum(symbols, v.base - 1)])
        raw = [chr(c).encode() for c in codes[strange].tolist()]
        count = np.ones(len(symbols), np.int64)
        count[strange] = [len(r) for r in raw]
        ids, segment = np.repeat(symbols, count), np.repeat(segment, count)
        ids[np.repeat(strange, count)] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        symbols = ids
    return symbols.astype(np.int32), np.searchsorted(segment, np.arange(len(starts) + 1))


class Encoder:
    """Encodes blocks; remembers the ids of segments that it has met, up to a fixed number.

    A hash finds a remembered segment and its bytes confirm it; one whose bytes differ is merged by itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.bytes, self.places = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, offsets = encode_segments(self.v, data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entry = np.insert(self.entry, at, len(self.offsets) - 1 + np.arange(len(hashes)))
        self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.bytes = np.concatenate([self.bytes, data[gather_ranges(starts, ends - starts)]])
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(ends - starts)])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the block end to end, and row offsets."""
        filled = np.diff(block.offsets) > 0
        if not filled.any():
            return np.zeros(0, np.int32), np.zeros(block.rows + 1, np.int64)
        added = np.concatenate([[0], np.cumsum(filled)]) if self.v.add_prefix else np.zeros(block.rows + 1, np.int64)
        data = np.insert(block.data, block.offsets[:-1][filled], 32) if self.v.add_prefix else block.data
        rows = block.offsets + added
        cut = np.zeros(len(data), bool)
        cut[1:] = self.v.cuts[(data[:-1].astype(np.int32) << 8) | data[1:]]
        cut[rows[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        found, first, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED or len(self.bytes) > REMEMBERED_BYTES:
            self.forget()
        at = np.searchsorted(self.hashes, found)
        new = (at == len(self.hashes)) | (self.hashes[np.minimum(at, len(self.hashes) - 1)] != found) if len(self.hashes) else np.ones(len(found), bool)
        if new.any():
            self.learn(found[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.hashes, found)
        entry = self.entry[at][which]
        other = np.flatnonzero(~same_ranges(data, starts, ends, self.bytes, self.places[entry], self.places[entry + 1]))
        ids, offsets = self.ids, self.offsets
        if len(other):
            more, upto = encode_segments(self.v, data, starts[other], ends[other])
            entry[other] = len(offsets) - 1 + np.arange(len(other))
            ids, offsets = np.concatenate([ids, more]), np.concatenate([offsets, upto[1:] + offsets[-1]])
        lengths = offsets[entry + 1] - offsets[entry]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids[gather_ranges(offsets[entry], lengths)], total[np.searchsorted(starts, rows)]


def decode(v: Vocabulary, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of each row of ids and row offsets; the space that the encoder put in front goes."""
    lengths = v.piece_offsets[ids + 1] - v.piece_offsets[ids]
    data = v.piece_bytes[gather_ranges(v.piece_offsets[ids], lengths)]
    offsets = np.concatenate([[0], np.cumsum(lengths)])[rows]
    if v.add_prefix and len(data):
        begin = offsets[:-1][np.diff(offsets) > 0]
        drop = begin[data[begin] == 32]
        offsets = offsets - np.searchsorted(drop, offsets)
        data = np.delete(data, drop)
    return data, offsets


def encode(docs: DataFrame, model: str, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with ids (array of int) and, if with_text, decoded: what decoding those ids gives.

    model: path of a SentencePiece BPE model that the driver can read; its tables, whose size depends
    on the vocabulary alone, are sent to the executors.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model))
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    fields = [docs.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = pc.cast(batch.column(batch.num_columns - 1), pa.large_string())
            if pc.any(pc.match_substring(column, MARK)).as_py():
                column = pc.replace_substring(column, MARK, " ")
            for b in blocks(column):
                ids, rows = encoder.encode(b)
                out = [c.slice(b.lo, b.rows) for c in batch.columns[:-1]]
                out.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids)))
                if with_text:
                    data, offsets = decode(encoder.v, ids, rows)
                    out.append(pa.Array.from_buffers(pa.string(), b.rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
                yield pa.RecordBatch.from_arrays(out, names=[*rest, "ids", "decoded"][: len(out)])

    return docs.select(*rest, F.col(text).alias(unused(docs, "_text"))).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
