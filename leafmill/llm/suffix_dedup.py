"""Repeated-substring removal by merging Burrows-Wheeler transforms.

Every byte that lies in a LENGTH-byte string which also starts earlier (at a smaller id, or earlier in the
same document) is removed.  The work is dealt out by content, so that equal strings meet:

  1. Each window of LENGTH bytes belongs to the smallest-hashed K-gram inside it (its minimiser); equal
     windows have equal minimisers.  Consecutive windows of one minimiser are a segment, a row of a few
     numbers.  K-grams that a sample of texts shows to be frequent come last in the order, so that no
     minimiser gathers a large share of the corpus; the sample only shapes the order, never the result.
  2. Rows meet by minimiser, sorted, and are streamed.  A minimiser with one segment has no repeats.  Of the
     others each different segment is opened, and with it its second occurrence, if it has one.  Further
     occurrences of the same segment are not indexed again: they are what the second one is.  (With
     prune=False every occurrence is; the result is the same.)
  3. The bytes of opened segments are fetched and indexed.  They belong to SHARDS shards by their document; a
     shard has its suffix order and Burrows-Wheeler transform, in the order of the bytes.  The transforms are
     merged by iterative interleave refinement: each round moves every suffix to the bucket of the symbol
     before it and so refines the interleave by one symbol; where a round first separates neighbours, their
     common prefix ends, and its length is kept.  No suffix is sorted again: only shard numbers and lengths
     move.  Neighbours with a common prefix of LENGTH bytes form the repeated intervals.  A symbol is STEP
     bytes, so LENGTH / STEP rounds are enough.

Edge cases: null is the empty text; texts shorter than LENGTH lose nothing; very long texts are blocks of
their own; ids must be integers, other ids fail; rows with a null id are passed through whole; rows that
repeat an id are taken for the same document with the same text (a position is not earlier than itself) and cut alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import spread, table, threshold, written
from leafmill.llm.textbytes import U64, Block, arrow_bytes, blocks, gather_ranges, lanes, mix, new_key, range_hashes

LENGTH = 100
#: Length of the K-grams of which the smallest deals out a window.
K = 24
#: Bytes of a symbol of the merged transforms; divides LENGTH.
STEP = 20
#: Shards of a merge, and bytes that are merged at once: what stays in a core's cache.
SHARDS, MERGE_BYTES = 4, 1 << 16
#: Opened bytes of one minimiser from which its windows are dealt out further.
CROWDED_BYTES = 64 * MERGE_BYTES
#: Texts whose minimisers are counted to find frequent ones, and how many of those are told apart.
SAMPLED, FREQUENT = 20_000, 4096

_TOP = U64(0xFFFFFF << 40)
_SEGMENTS = "k long, s long, id long, at long"


def segments(block: Block, frequent: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, content hash, row, start within the row, and number of windows of every segment of a block."""
    data, n = block.data, len(block.data)
    none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
    if n < LENGTH:
        return none
    view, grams = lanes(data), n - K + 1
    gram = view[:grams] * U64(0x9FB21C651E98DF25)
    gram ^= gram >> U64(29)
    gram += view[8 : 8 + grams] * U64(0xC2B2AE3D27D4EB4F)
    gram ^= gram >> U64(31)
    gram += view[16 : 16 + grams]
    gram *= U64(0x9E3779B97F4A7C15)
    gram ^= gram >> U64(32)
    gram >>= U64(1)
    if len(frequent):
        maybe = np.zeros(1 << 20, bool)
        maybe[(frequent & U64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(gram & U64((1 << 20) - 1)).astype(np.int64)])
        at = at[np.isin(gram[at], frequent)]
        gram[at] |= U64(1 << 63)
    width, reach = LENGTH - K + 1, 1
    # the order is that of the top bits, then of the place, so the leftmost of equals is the minimiser and a
    # segment, whose windows have it at different offsets, holds no window twice
    least = (gram & _TOP) | np.arange(len(gram), dtype=U64)
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        extra = width - reach
        least = np.minimum(least[:-extra], least[extra:])
    valid = np.ones(len(least), bool)  # windows start at 0 to n - LENGTH
    short = block.offsets[1:-1]
    crossing = gather_ranges(np.maximum(short - LENGTH + 1, 0), np.minimum(short, LENGTH - 1))
    valid[crossing[crossing < len(valid)]] = False
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | begins[1:]
    count = np.flatnonzero(stops) + 1 - starts
    row = np.searchsorted(block.offsets, starts, "right") - 1
    return gram[(least[starts] & ~_TOP).astype(np.int64)], range_hashes(data, starts, starts + count + LENGTH - 1, key), row, starts - block.offsets[row], count


def scan(frequent: np.ndarray, key: int, prune: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to segments; at holds start, windows and a mark of segments that are at least the third of their bytes in the batch."""
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
            for b in blocks(batch.column(1), 1 << 19):
                k, s, row, start, count = segments(b, frequent, key)
                parts.append((k, s, ids[b.lo + row], start, count))
            k, s, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            if not len(k):
                continue
            again = np.zeros(len(k), bool)
            order = np.argsort(s, kind="stable")
            # equal segments have equal minimisers, too
            same = (s[order][2:] == s[order][:-2]) & (k[order][2:] == k[order][:-2])
            if prune and same.any():
                member = np.zeros(len(k), bool)
                for shift in range(3):
                    member[shift : len(k) - 2 + shift] |= same
                few = order[member]
                few = few[np.lexsort((start[few], doc[few], k[few], s[few]))]
                begins = np.ones(len(few), bool)
                begins[1:] = (s[few][1:] != s[few][:-1]) | (k[few][1:] != k[few][:-1])
                new = begins.copy()  # a place of its own among the segments of the same bytes
                new[1:] |= (doc[few][1:] != doc[few][:-1]) | (start[few][1:] != start[few][:-1])
                place = np.cumsum(new)
                again[few] = place - np.maximum.accumulate(np.where(begins, place, 0)) >= 2
            # those only pass through: neighbours join, up to what fits, and their keys spread them
            follows = np.zeros(len(k), bool)
            follows[1:] = again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + count[:-1])
            head = np.flatnonzero(~(follows & (np.arange(len(k)) % 64 != 0)))
            count = np.add.reduceat(count, head)
            k, s, doc, start, again = k[head], s[head], doc[head], start[head], again[head]
            k = np.where(again, mix(s + start.astype(U64)), k)
            at = (start << 16) | (count << 1) | again
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(at)], names=["k", "s", "id", "at"])

    return run


_SETTLED = "k long, id long, start long, windows long, twin boolean, id2 long, start2 long, open boolean"


def settled_rows(k: np.ndarray, doc: np.ndarray, at: np.ndarray, open_: bool, twin: np.ndarray | None = None, doc2: np.ndarray | None = None, at2: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(k), np.int64)
    columns = [k, doc, at >> 16, (at & 0xFFFF) >> 1, np.zeros(len(k), bool) if twin is None else twin, none if doc2 is None else doc2, none if at2 is None else at2 >> 16, np.full(len(k), open_)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _SETTLED.split(", ")])


def settle(prune: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted segments of whole minimisers to those to be merged (open; with the second occurrence as a twin), and further occurrences of their bytes.

        One row is held back between batches, whatever the size of a minimiser.
        """
        last: tuple | None = None  # the row before, as (k, s, id, at)
        held: list | None = None  # the last row, where it is the first of its bytes, and whether it is the first of its minimiser
        seen = 0  # rows of the last row's bytes
        for batch in chain(batches, [None]):
            if batch is not None:
                k, s, doc, at = (batch.column(c).to_numpy() for c in range(4))
                again = (at & 1).astype(bool)
                if again.any():
                    yield settled_rows(k[again], doc[again], at[again], False)
                    k, s, doc, at = (x[~again] for x in (k, s, doc, at))
                if not len(k):
                    continue
                twice = np.zeros(len(k), bool)  # rows of one id, twice in the table
                twice[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
                twice[0] = last == (k[0], s[0], doc[0], at[0])
                before, last = last, (k[-1], s[-1], doc[-1], at[-1])
                k, s, doc, at = (x[~twice] for x in (k, s, doc, at))
                if not len(k):
                    continue
                new_k, new_s = np.ones(len(k), bool), np.ones(len(k), bool)
                new_k[1:] = k[1:] != k[:-1]
                new_s[1:] = new_k[1:] | (s[1:] != s[:-1])
                new_k[0] = before is None or before[0] != k[0]
                new_s[0] = new_k[0] or before[1] != s[0]
                if held is not None:
                    k, s, doc, at = (np.concatenate([[x], y]) for x, y in zip(held, (k, s, doc, at), strict=False))
                    new_k, new_s = np.concatenate([[held[4]], new_k]), np.concatenate([[True], new_s])
            elif held is not None:
                k, s, doc, at, new_k = (np.array([x]) for x in held)
                new_s = np.ones(1, bool)
            else:
                return
            n, place = len(k), np.arange(len(k))
            nth = place - np.maximum.accumulate(np.where(new_s, place, -seen))
            held, seen = None, int(nth[-1]) + 1
            if batch is not None and nth[-1] == 0:
                held, n = [k[-1], s[-1], doc[-1], at[-1], new_k[-1]], n - 1
            alone = new_k & np.append(new_k[1:], True)
            first = np.flatnonzero((nth[:n] == 0) & ~alone[:n]) if prune else np.flatnonzero(~alone[:n])
            follow = np.minimum(first + 1, len(k) - 1)
            twin = (nth[follow] == 1) & (follow > first) & prune
            if len(first):
                yield settled_rows(k[first], doc[first], at[first], True, twin, np.where(twin, doc[follow], 0), np.where(twin, at[follow], 0))
            more = np.flatnonzero(nth[:n] >= 2)
            if prune and len(more):
                yield settled_rows(k[more], doc[more], at[more], False)

    return run


def sorted_places(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable sorting permutation of non-negative keys below 2**width, and the sorted keys.

    Where a key and its place fit into one number, the numbers themselves are sorted, which is several times cheaper than to sort places by keys.
    """
    bits = len(key).bit_length()
    if width + bits > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key.astype(np.int64) << bits
    both |= np.arange(len(key))
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def dense_ranks(key: np.ndarray, width: int) -> np.ndarray:
    """Rank from 0 of each key among the different keys."""
    order, key = sorted_places(key, width)
    rank, fresh = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    rank[order] = np.cumsum(fresh)
    return rank


def byte_ranks(data: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Rank from 0, in the order of the bytes, of the ``size`` bytes from each place on; equal strings have equal ranks.

    The ranks of the first and of the last ``reach`` bytes rank up to twice as many.
    """
    n, reach = len(data), min(size, 5)
    view = np.ndarray((n + 1,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = place if reach == size else slice(n)
    rank = dense_ranks((view[at].astype(U64) >> U64(64 - 8 * reach)).view(np.int64), 8 * reach)
    while reach < size:
        longer = min(2 * reach, size)
        width = int(rank.max(initial=0)).bit_length()
        last = np.concatenate([rank[longer - reach :], np.zeros(longer - reach, np.int64)])  # what the end cuts off is never asked for
        rank, last = (rank[place], last[place]) if longer == size else (rank, last)
        rank, reach = dense_ranks((rank << width) | last, 2 * width), longer
    return rank


class Collection:
    """Segments as strings of STEP-byte symbols, one string for each residue of the position.

    Nodes are the places where a symbol starts, and an end for every string.  code is the symbol at a
    node, numbered from 1 in the order of its bytes (0 at an end), back the node one symbol earlier (-1 at the
    start of a string).
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, step: int = STEP):
        n = lengths - step + 1  # symbols of a segment; LENGTH or more bytes leave some
        self.first = np.concatenate([[0], np.cumsum(n)])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        place = gather_ranges(offsets[:-1], n)
        self.symbols = len(place)
        self.code = byte_ranks(data, place, step) + 1
        self.segment = np.repeat(np.arange(len(n)), n)
        self.at = place - offsets[self.segment]
        self.has_next = self.at + step < n[self.segment]
        self.step = step

    def order(self, lo: int, hi: int) -> np.ndarray:
        """Nodes of segments lo to hi in suffix order, ends first; ends are numbered from self.symbols on, by the node before them."""
        a, b = self.first[lo], self.first[hi]
        n = b - a
        nxt = np.where(self.has_next[a:b], np.arange(n) + self.step, n)
        ends = np.flatnonzero(~self.has_next[a:b])
        # an end's rank is its string's number, so that equal strings have an order
        rank = np.empty(2 * n + 1, np.int64)
        rank[:n] = self.code[a:b] + len(ends)
        nxt[ends] = n + 1 + np.arange(len(ends))
        rank[n + 1 : n + 1 + len(ends)] = np.arange(len(ends))
        total = n + 1 + len(ends)
        rank, follow = rank[:total], np.concatenate([nxt, [n], np.arange(n + 1, total)])
        rank[n] = 0
        width = int(max(rank.max(), total)).bit_length()
        while True:
            order, key = sorted_places((rank[:n] << width) | rank[follow[:n]], 2 * width)
            fresh = np.ones(n, bool)
            fresh[1:] = key[1:] != key[:-1]
            rank[order] = np.cumsum(fresh) + (len(ends) - 1)
            if fresh.all():
                break
            follow = follow[follow]
        return np.concatenate([self.symbols + a + ends, a + order])


def merge_transforms(collection: Collection, cuts: np.ndarray, rounds: int = LENGTH // STEP) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of the shards, which are the segments between cuts.

    Returns all nodes in the order of their first ``rounds`` symbols, and for each the number of symbols that
    it has in common with the node before it, ``rounds`` at most.
    """
    c = collection
    orders, before, ends = [], [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        order = c.order(lo, hi)
        node = np.where(order >= c.symbols, order - c.symbols, order - c.step)  # what stands one symbol earlier
        starts = (order < c.symbols) & (c.at[np.minimum(order, c.symbols - 1)] < c.step)
        before.append(np.where(starts, 0, c.code[np.where(starts, 0, node)]).astype(np.int32))
        orders.append(order)
        ends.append(int((order >= c.symbols).sum()))
    origin = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(o) for o in orders])
    bottom = np.repeat(np.arange(len(orders), dtype=np.uint8), ends)  # the ends keep their shards' order
    # a shard's own moves are the same in all rounds: its suffixes by the symbol before them, those at a string's start left out
    width, bits = int(c.code.max(initial=0)).bit_length(), len(origin).bit_length()
    moves = [sorted_places(x, width) for x in before]
    moves = [(order[code > 0], code[code > 0].astype(np.int64) << bits) for order, code in moves]
    block = np.zeros(len(origin), np.int32)
    common = np.full(len(origin), rounds, np.int8)
    split = np.ones(len(origin), bool)
    split[1 : len(bottom)] = False
    for depth in range(rounds):
        # each shard's suffixes are in order of the symbol and of their place, so this merges sorted runs
        key = np.sort(np.concatenate([code | np.flatnonzero(origin == k)[order] for k, (order, code) in enumerate(moves)]), kind="stable")
        move = key & ((1 << bits) - 1)
        key >>= bits
        was = block[move]
        split[len(bottom) + 1 :] = (key[1:] != key[:-1]) | (was[1:] != was[:-1])
        # a place at which neighbours part stays one, so the first round that parts them tells their common prefix
        np.putmask(common, split & (common == rounds), depth)
        block = np.cumsum(split, dtype=np.int32)
        origin = np.concatenate([bottom, origin[move]])
    nodes = np.empty(len(origin), np.int64)
    for k, order in enumerate(orders):
        nodes[origin == k] = order
    return nodes, common


def interleave(collection: Collection, shards: int = SHARDS, rounds: int = LENGTH // STEP) -> tuple[np.ndarray, np.ndarray]:
    """The merge of equally many segments a shard: nodes, and the number of each one's block of equals."""
    n = len(collection.first) - 1
    nodes, common = merge_transforms(collection, np.linspace(0, n, min(shards, n) + 1).astype(int), rounds)
    return nodes, np.cumsum(common < rounds)


def shard_of(doc: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(SHARDS)).astype(np.int64)


def repeated(data: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window of each segment, in order, whether an earlier window is equal.  data: segments end to end."""
    order = np.argsort(shard_of(doc), kind="stable")
    offsets = np.cumsum(lengths) - lengths
    data, n, doc, start = data[gather_ranges(offsets[order], lengths[order])], lengths[order], doc[order], start[order]
    shard = shard_of(doc)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
    c = Collection(data, n)
    nodes, common = merge_transforms(c, cuts)
    windows = n - LENGTH + 1
    # nodes that begin a window, and the intervals of those with LENGTH common bytes
    interval = np.cumsum(common < LENGTH // STEP)
    inside = np.flatnonzero(nodes < c.symbols)
    inside = inside[c.at[nodes[inside]] < windows[c.segment[nodes[inside]]]]
    nodes, interval = nodes[inside], interval[inside]
    seg, at = c.segment[nodes], c.at[nodes]
    place = np.empty(len(n), np.int64)
    place[np.lexsort((start, doc))] = np.arange(len(n))
    key = (place[seg] << 32) | at
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(key))))
    head = np.argsort(place, kind="stable")[least >> 32]
    # a window of a row that repeats an id stands at the same place as its twin
    twin = (doc[seg] == doc[head]) & (start[seg] + at == start[head] + (least & 0xFFFFFFFF))
    flag = np.zeros(len(data), bool)
    begin = np.cumsum(n) - n
    flag[begin[seg] + at] = (key > least) & ~twin
    back = np.empty(len(n), np.int64)
    back[order] = begin
    return flag[gather_ranges(back, lengths - LENGTH + 1)]


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, opened segments as lists) to (k, lot, id, start, bytes, twin, id2, start2), a row for each segment or, of a crowded minimiser, for each run of windows of one lot."""
    names = ["k", "lot", "id", "start", "bytes", "twin", "id2", "start2"]
    for batch in batches:
        for b in blocks(batch.column(1)):
            lists = [c.slice(b.lo, b.rows) for c in batch.columns[2:]]
            row = np.repeat(np.arange(b.rows), lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            k, start, windows, lots, twin, id2, start2 = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            here = start + windows + (LENGTH - 1) <= np.diff(b.offsets)[row]  # another text of the same id may be shorter
            row, k, start, windows, lots, twin, id2, start2 = (x[here] for x in (row, k, start, windows, lots, twin, id2, start2))
            ids = batch.column(0).slice(b.lo, b.rows).to_numpy(zero_copy_only=False)[row]
            begin, lot = b.offsets[row] + start, np.zeros(len(k), np.int64)
            crowded = np.flatnonzero(lots > 1)
            if len(crowded):
                cut = np.concatenate([np.arange(len(k))[lots <= 1], crowded])
                runs, size, which = window_runs(b.data, begin[crowded], windows[crowded], lots[crowded])
                kept = len(k) - len(crowded)
                of = np.concatenate([cut[:kept], crowded[runs[0]]])
                shift = np.concatenate([np.zeros(kept, np.int64), runs[1]])
                lot, windows = np.concatenate([np.zeros(kept, np.int64), which]), np.concatenate([windows[cut[:kept]], size])
                k, start, begin, ids, twin, id2, start2 = k[of], start[of] + shift, begin[of] + shift, ids[of], twin[of], id2[of], start2[of] + shift
            for lo in range(0, len(k), 50_000):
                part = slice(lo, lo + 50_000)
                n = windows[part] + LENGTH - 1
                data = arrow_bytes(b.data[gather_ranges(begin[part], n)], np.concatenate([[0], np.cumsum(n)]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(lot[part]), pa.array(ids[part]), pa.array(start[part]), data, pa.array(twin[part]), pa.array(id2[part]), pa.array(start2[part])], names=names)


def window_runs(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, lots: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Runs of consecutive windows that fall into one lot by the hash of a window's first symbol: (segment, shift), number of windows, lot.

    Equal windows come into one lot, so the lots can be judged apart.
    """
    segment = np.repeat(np.arange(len(begin)), windows)
    place = gather_ranges(begin, windows)
    lot = (range_hashes(data, place, place + STEP) % lots[segment].astype(U64)).astype(np.int64)
    head = np.ones(len(place), bool)
    head[1:] = (segment[1:] != segment[:-1]) | (lot[1:] != lot[:-1])
    head = np.flatnonzero(head)
    return (segment[head], place[head] - begin[segment[head]]), np.diff(np.append(head, len(place))), lot[head]


def recut(data: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The segments as they are; if they are too many bytes at once, in lots of windows that are judged apart."""
    lots = -(-len(data) // (64 * MERGE_BYTES))
    if lots == 1:
        yield data, lengths, doc, start
        return
    offsets = np.cumsum(lengths) - lengths
    (segment, shift), windows, lot = window_runs(data, offsets, lengths - LENGTH + 1, np.full(len(lengths), 4 * lots))
    for x in range(4 * lots):
        mine = np.flatnonzero(lot == x)
        if len(mine):
            n, seg = windows[mine] + LENGTH - 1, segment[mine]
            yield data[gather_ranges(offsets[seg] + shift[mine], n)], n, doc[seg], start[seg] + shift[mine]


def merged_runs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows (id, start, windows) in whole groups of (k, lot)."""
    b = next(blocks(rows.column("bytes"), 1 << 62))
    lengths = np.diff(b.offsets)
    doc, start, twin, doc2, start2 = (rows.column(c).to_numpy() for c in ("id", "start", "twin", "id2", "start2"))
    second = np.flatnonzero(twin)
    data = np.concatenate([b.data, b.data[gather_ranges(b.offsets[second], lengths[second])]])
    both = (np.concatenate([x, y[second]]) for x, y in ((lengths, lengths), (doc, doc2), (start, start2)))
    for d, n, ids, at in recut(data, *both):
        flag = repeated(d, n, ids, at)
        begin = np.concatenate([[0], np.cumsum(n - LENGTH + 1)])
        edge = np.zeros(len(flag) + 1, bool)
        edge[begin] = True
        head = np.flatnonzero(flag & (edge[:-1] | ~np.concatenate([[False], flag[:-1]])))
        tail = np.flatnonzero(flag & (edge[1:] | ~np.concatenate([flag[1:], [False]])))
        seg = np.searchsorted(begin, head, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[seg]), pa.array(at[seg] + head - begin[seg]), pa.array(tail + 1 - head)], names=["id", "start", "windows"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opened segments, sorted by (k, lot), to runs of repeated windows; about MERGE_BYTES of whole groups are held and merged at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.column(4).nbytes
            if size < MERGE_BYTES:
                continue
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or not rows.num_rows:
            continue
        k, lot = (rows.column(c).to_numpy() for c in ("k", "lot"))
        edges = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (lot[1:] != lot[:-1])]))
        if batch is None:
            edges = np.append(edges, len(k))  # otherwise the last group may go on
        total = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())])
        i = 0
        while i < len(edges) - 1:
            j = min(max(int(np.searchsorted(total[edges], total[edges[i]] + MERGE_BYTES, "right")) - 1, i + 1), len(edges) - 1)
            yield from merged_runs(rows.slice(edges[i], edges[j] - edges[i]))
            i = j
        held, size = [x for x in rows.slice(edges[-1]).combine_chunks().to_batches() if x.num_rows], 0


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, starts, windows) to (id, n_bytes, n_removed, n_spans, kept): kept is what remains of the text."""
    for batch in batches:
        starts, windows = batch.column(2), batch.column(3)
        for b in blocks(batch.column(1)):
            delta = np.zeros(len(b.data) + 1, np.int64)
            lists = starts.slice(b.lo, b.rows), windows.slice(b.lo, b.rows)
            at, n = (x.flatten().to_numpy() for x in lists)
            row = np.repeat(np.arange(b.rows), lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = np.minimum(b.offsets[row] + at, b.offsets[row + 1])
            hi = np.minimum(lo + n + LENGTH - 1, b.offsets[row + 1])
            np.add.at(delta, lo, 1)
            np.add.at(delta, hi, -1)
            gone = np.cumsum(delta[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[b.offsets]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = b.offsets[:-1][b.offsets[:-1] < len(gone)]
            edge[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(edge)])[b.offsets]
            kept, offsets = b.data[~gone], b.offsets - removed
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.lo, b.rows), pa.array(np.diff(b.offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.Array.from_buffers(pa.binary(), b.rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Minimisers that are common in about SAMPLED texts; FREQUENT of them at most."""
    n = docs.count()
    if not n:
        return np.zeros(0, U64)
    rows = docs.where(spread("minimisers", "id") <= threshold(SAMPLED, n)).mapInArrow(scan(np.zeros(0, U64), new_key(), prune=False), _SEGMENTS)
    found = rows.select("k", "s").distinct().groupBy("k").count().where(F.col("count") >= max(20, min(n, SAMPLED) // 500)).orderBy(F.desc("count"), "k").limit(FREQUENT).collect()
    return np.sort(np.array([r["k"] for r in found], np.int64).view(U64))


def repeated_spans(docs: DataFrame, prune: bool = True) -> DataFrame:
    """Runs of repeated windows (id, start, windows) of docs (id, text); prune: do not index a segment's third and later occurrences."""
    rows = docs.mapInArrow(scan(frequent_grams(docs), new_key(), prune), _SEGMENTS)
    settled = written(rows.repartition("k").sortWithinPartitions("k", "s", "id", "at").mapInArrow(settle(prune), _SETTLED), "segments")
    opened = settled.where("open")
    size = F.sum((F.col("windows") + (LENGTH - 1)) * F.when(F.col("twin"), 2).otherwise(1))
    crowded = opened.groupBy("k").agg(size.alias("bytes")).where(F.col("bytes") > CROWDED_BYTES).select("k", F.ceil(4 * F.col("bytes") / CROWDED_BYTES).cast("long").alias("lots"))
    opened = opened.join(crowded, "k", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    columns = ("k", "start", "windows", "lots", "twin", "id2", "start2")
    lists = opened.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("s"))
    texts = docs.join(lists, "id").select("id", "text", *(F.col(f"s.{c}").alias(c) for c in columns))
    pieces = texts.mapInArrow(cut_out, "k long, lot long, id long, start long, bytes binary, twin boolean, id2 long, start2 long")
    merged = pieces.repartition("k", "lot").sortWithinPartitions("k", "lot").mapInArrow(merge, "id long, start long, windows long")
    return settled.where("not open").select("id", "start", "windows").unionByName(merged)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", prune: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (bytes that remain) of every row."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = docs.where(F.col("id").isNotNull())
    spans = repeated_spans(known, prune)
    found = spans.groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    lists = known.join(found, "id", "left").select("id", "text", F.col("found.start").alias("starts"), F.col("found.windows").alias("windows"))
    none = F.lit(None).cast("array<bigint>")
    lists = lists.unionByName(docs.where(F.col("id").isNull()).select("id", "text", none.alias("starts"), none.alias("windows")))
    return lists.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
