"""Phrase collocations by prefix-projected pattern growth.

Every word occurrence is a pointer to itself and the words after it, up to LONGEST in all and never across the end of a
piece: the projection of each prefix that begins there.  Patterns grow to the right only:

  1. Words are counted, then, by hash, pairs whose words are frequent, and so on up to one word less than LONGEST.  A
     sieve, a bitmap of fixed size, remembers what is frequent; it passes all of that and little else, so it saves work
     and decides nothing.  A projection ends where a sieve stops it: no frequent phrase goes on there.
  2. Equal projections of a block of texts are counted where they are read, and summed over the corpus.
  3. The sums are range-partitioned and sorted by language and words, so the projected database of each prefix is a run
     of neighbouring rows, and the one of every longer prefix a run inside it.  A task takes its prefixes one by
     one: it holds pointers to the run, cuts it where the next word changes, and grows each part that is frequent
     depth-first.  A part that is not frequent is not looked into again.
  4. A run may go on beyond a task's rows (a prefix with a third of all rows is shared by many tasks): the prefixes
     at the first and last row are given out with what was counted, whole or not, and summed at the end.

Counts of all frequent phrases of 1 to LONGEST words follow.  Each part of a frequent phrase is frequent, so scores
and containment are joins among them.  Scores are exact: products are decimals of 38 digits.

Edge cases: a null text is empty, a null language ``und``; texts without words give nothing; very long texts are blocks
of their own; repeated rows count each time; ties are ordered by count, then by the phrase's bytes; an empty table gives no
rows; columns other than the text and the language are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import table, written
from leafmill.llm.textbytes import LOWER, U64, Block, arrow_bytes, blocks, buffer, gather_ranges, mix, range_hashes, same_ranges, words

LONGEST, LEAST = 4, 30
#: A phrase goes where a longer one that holds it has this share of its count, in hundredths.
HELD = 80
BEST, SCALE = 2000, 2_000_000
#: Bytes of text whose equal projections are counted together before anything is shuffled.
BLOCK = 1 << 20
#: Projections that are handed on together.
ROWS = 20_000
#: Bits of a sieve (8 MB), and how many of them a phrase sets.
BITS, PROBES = 1 << 26, 3

GAP = np.zeros(256, bool)
GAP[[9, 32, *b".,;:!?", 10, 11, 12, 13]] = True
END = np.zeros(256, bool)
END[[*b".,;:!?", 10, 11, 12, 13]] = True
SPACE = 32


@dataclass
class Tokens:
    """Words of a block: a number for each different word, whether the next one is in the same piece, its language, and hashes."""

    codes: np.ndarray
    joined: np.ndarray
    group: np.ndarray
    name_bytes: np.ndarray
    name_at: np.ndarray
    name_hashes: np.ndarray
    group_hashes: np.ndarray

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the language and the ``size`` words from each place on."""
        return phrase_hashes(self.group_hashes[self.group[at]], [self.name_hashes[self.codes[at + k]] for k in range(size)])


def phrase_hashes(langs: np.ndarray, words_of: list[np.ndarray]) -> np.ndarray:
    h = langs
    for w in words_of:
        h = mix(h * U64(3) ^ w)
    return h


def text_hashes(texts: pa.Array) -> np.ndarray:
    data, offsets = buffer(texts)
    return range_hashes(data, offsets[:-1], offsets[1:])


def tokens(block: Block, group: np.ndarray, group_hashes: np.ndarray) -> Tokens:
    data = LOWER[block.data]
    w = words(Block(block.lo, block.hi, data, block.offsets), GAP)
    lengths, row = w.ends - w.starts, w.row_of()
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(data[gather_ranges(w.starts, lengths)])])
    coded = flat.dictionary_encode()
    name_bytes, name_at = buffer(coded.dictionary)
    # two neighbours are of one piece where no sign lies between them and no row ends
    signs = np.concatenate([[0], np.cumsum(END[data])])
    joined = np.append((signs[w.starts[1:]] == signs[w.ends[:-1]]) & (row[1:] == row[:-1]), False) if len(row) else np.zeros(0, bool)
    return Tokens(np.asarray(coded.indices).astype(np.int64), joined, group[row], name_bytes, name_at, range_hashes(name_bytes, name_at[:-1], name_at[1:]), group_hashes)


@dataclass
class Sieve:
    """A Bloom filter of BITS bits, whatever it holds."""

    bits: np.ndarray

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        step = (h >> U64(32)) | U64(1)
        return [((h + U64(j) * step) & U64(BITS - 1)).astype(np.int64) for j in range(PROBES)]

    def passes(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1) == 1
        return out


def sieve(frequent: DataFrame) -> Sieve:
    """A filter of hashes (column h); what is collected has the filter's fixed size."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(Sieve.places(np.asarray(batch.column(0)).view(np.uint64)))
            word, which = np.unique(at >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, which, U64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = frequent.select("h").mapInArrow(place, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[np.asarray(found.column("word"), np.int64)] = np.asarray(found.column("mask"), np.int64).view(np.uint64)
    return Sieve(bits)


def word_hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) to h, as Tokens hashes them."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(text_hashes(batch.column(0)), [text_hashes(batch.column(1))]).view(np.int64))], names=["h"])


def plausible(t: Tokens, sieves: list[Sieve]) -> list[np.ndarray]:
    """For k = 1, 2 and so on, up to one more than there are sieves: whether the k words from each place on pass all sieves of their parts.

    The last one has no sieve of its own: its two longest parts have passed.
    """
    n = len(t.codes)
    _, first, which = np.unique(t.group * np.int64(len(t.name_at)) + t.codes, return_index=True, return_inverse=True)
    out = [sieves[0].passes(t.hashes(first, 1))[which]]
    for k in range(2, len(sieves) + 2):
        next_to = np.append(out[-1][1:], False) if n else out[-1]
        good = out[-1] & next_to & (t.joined if k == 2 else True)
        if k <= len(sieves):
            at = np.flatnonzero(good)
            good[at] = sieves[k - 1].passes(t.hashes(at, k))
        out.append(good)
    return out


def projections(t: Tokens, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different runs of ``size`` words from the places ``at`` on: their language, words, word offsets and counts.

    Words are given as ranges of the returned bytes, a space after each.  (group, bytes, offsets, counts)
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    codes = np.append(t.codes, np.zeros(int(size.max()), np.int64))
    columns = [np.where(size > k, codes[at + k] + 1, 0) for k in range(int(size.max()))]
    key, below, width = t.group[at], int(t.group.max()) + 1, len(t.name_at)
    for column in columns:
        if below * width >= 1 << 62:  # number what there is anew
            key, below = np.unique(key, return_inverse=True)[1], len(at)
        key, below = key * width + column, below * width
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    parts = codes[gather_ranges(at[first], size[first])]
    lengths = t.name_at[parts + 1] - t.name_at[parts]
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]), SPACE, np.uint8)
    out[gather_ranges(ends - lengths - 1, lengths)] = t.name_bytes[gather_ranges(t.name_at[parts], lengths)]
    return t.group[at[first]], out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size[first])])], counts


def grow(ends: np.ndarray, changes: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Grow the prefixes of sorted projections depth-first: (row, words, end, count) of each frequent one.

    ends[k][i] is where the first k + 1 words of row i end (-1: it has fewer), changes[k][i] whether they differ
    from the row before.  A prefix is a run of rows, given by pointers to its first and last one; a run that touches
    either end of the rows may go on elsewhere and is given out however often it occurs.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    starts = [np.append(np.flatnonzero(c), n) for c in changes]

    def extend(lo: int, hi: int, k: int) -> Iterator[tuple[int, int, int, int]]:
        a, b = np.searchsorted(starts[k], (lo, hi))
        first, last = starts[k][a:b], starts[k][a + 1 : b + 1]
        total = upto[last] - upto[first]
        taken = np.flatnonzero((ends[k][first] >= 0) & ((total >= least) | (first == 0) | (last == n)))
        for x, y, count in zip(first[taken].tolist(), last[taken].tolist(), total[taken].tolist(), strict=True):
            yield x, k + 1, int(ends[k][x]), count
            if k + 1 < len(starts):
                yield from extend(x, y, k + 1)

    return extend(0, n, 0)


def word_ends(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For each row and k, where its first k + 1 words end, the space after them included; -1 where it has fewer."""
    spaces = np.flatnonzero(data == SPACE)
    first = np.searchsorted(spaces, offsets)
    out = np.full((longest, len(offsets) - 1), -1, np.int64)
    for k in range(longest):
        has = first[:-1] + k < first[1:]
        out[k, has] = spaces[first[:-1][has] + k] + 1
    return out


def new_prefixes(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each k and row, whether its first k + 1 words (or all, where it has fewer) differ from those of the row before."""
    n = len(offsets) - 1
    out = np.ones((len(ends), n), bool)
    begin = offsets[:-1]
    same = group[1:] == group[:-1]
    for k in range(len(ends)):
        a, b = ends[k, :-1], ends[k, 1:]
        same = same & (a >= 0) & (b >= 0)
        at = np.flatnonzero(same)
        same[at] = same_ranges(data, begin[at], a[at], data, begin[at + 1], b[at])
        out[k, 1:] = ~same
    return out


def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, pa.Array]]:
    """The tokens of (lang, text) by block, and the languages that their groups are."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        group, hashes = np.asarray(coded.indices).astype(np.int64), text_hashes(coded.dictionary)
        for b in blocks(pc.cast(batch.column(1), pa.large_string()), BLOCK):
            yield tokens(b, group[b.lo : b.hi], hashes), coded.dictionary


def projected(docs: DataFrame, choose) -> DataFrame:
    """lang, follows and n: all different projections that ``choose`` takes (tokens to places and sizes) with their number."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, langs in token_blocks(batches):
            mine, data, offsets, counts = projections(t, *choose(t))
            for lo in range(0, len(mine), ROWS):
                hi = min(lo + ROWS, len(mine))
                follows = arrow_bytes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], pa.binary())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(mine[lo:hi])), follows, pa.array(counts[lo:hi])], names=["lang", "follows", "n"])

    return docs.mapInArrow(project, "lang string, follows binary, n long").groupBy("lang", "follows").agg(F.sum("n").alias("n"))


def hashed(docs: DataFrame, shared, size: int) -> DataFrame:
    """h and n: the hashes of the ``size`` words from each plausible place on, and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in token_blocks(batches):
            h, n = np.unique(t.hashes(np.flatnonzero(plausible(t, shared.value)[-1]), size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return docs.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to lang and n, the number of words."""
    for batch in batches:
        for b in blocks(pc.cast(batch.column(1), pa.large_string()), BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.rows), pa.array(np.diff(words(b, GAP).rows))], names=["lang", "n"])


def grown(projections_of: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, k and f of the frequent phrases of two words or more, from projections (lang, follows, n)."""
    dealt = projections_of.repartitionByRange("lang", "follows").sortWithinPartitions("lang", "follows")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(1))
            group, n = np.asarray(batch.column(0).dictionary_encode().indices), np.asarray(batch.column(2))
            ends = word_ends(data, offsets, longest)
            found = [x for x in grow(ends, new_prefixes(data, offsets, ends, group), n, least) if x[1] > 1]
            if found:
                row, k, end, total = (np.array(c) for c in zip(*found, strict=True))
                sizes = end - offsets[row] - 1  # without the last space
                phrase = arrow_bytes(data[gather_ranges(offsets[row], sizes)], np.concatenate([[0], np.cumsum(sizes)]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), phrase, pa.array(k.astype(np.int32)), pa.array(total)], names=["lang", "phrase", "k", "f"])

    parts = dealt.mapInArrow(take, "lang string, phrase binary, k int, f long")
    return parts.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by spaces), k (its words) and f (its occurrences), for all phrases with f >= least.

    A row with k = 0 and an empty phrase has the number of all word occurrences of each language.
    """
    told = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    share = docs.sparkSession.sparkContext.broadcast
    every = lambda t: (np.arange(len(t.codes)), np.ones(len(t.codes), np.int64))
    single = projected(told, every).where(F.col("n") >= least)
    word = F.expr("substring(follows, 1, octet_length(follows) - 1)").alias("phrase")
    single = written(single.select("lang", word, F.lit(1).alias("k"), F.col("n").alias("f")), "phrase-words")
    sieves = [sieve(single.select("lang", "phrase").mapInArrow(word_hashes_of, "h long"))]
    for size in range(2, longest):
        sieves.append(sieve(hashed(told, share(list(sieves)), size).where(F.col("n") >= least)))
    shared = share(sieves)

    def runs(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Places where a plausible pair begins, and how far plausible phrases go on."""
        good = plausible(t, shared.value)
        begin = np.flatnonzero(good[1])
        return begin, 2 + sum((g[begin].astype(np.int64) for g in good[2:]), np.zeros(len(begin), np.int64))

    totals = told.mapInArrow(word_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("f")).where("f > 0")
    totals = totals.select("lang", F.lit(b"").alias("phrase"), F.lit(0).alias("k"), "f")
    return single.unionByName(totals).unionByName(grown(projected(told, runs), longest, least)).withColumn("phrase", F.col("phrase").cast("string"))


def times(x: str, factor: int) -> str:
    """A product in 38 digits, where 64 bits may not be enough."""
    return f"cast({x} as decimal(20,0)) * cast({factor} as decimal(10,0))"


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r and score of every frequent phrase of two words or more, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    parts = counts.where("k >= 1").select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"phrase": side, "f": name}), ["lang", side]).drop(side)
    cuts = cuts.withColumn("score", F.expr(f"{times('a', SCALE)} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    return cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("lowest")).select("lang", "phrase", "k", "a", "lowest.l", "lowest.r", "lowest.score")


def holders(counts: DataFrame) -> DataFrame:
    """lang, phrase and the largest count (holder) of a longer frequent phrase that holds it."""
    part = lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), part))
    longer = counts.where("k >= 3").withColumn("words", F.split("phrase", " "))
    return longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("holder"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, held: int = HELD, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases that no longer phrase stands for."""
    counts = written(phrase_counts(docs, text, lang, longest, least), "phrases")
    left = scored(counts).join(holders(counts), ["lang", "phrase"], "left").where(f"holder is null or {times('holder', 100)} < {times('a', held)}")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES: dict[str, str] = {}
