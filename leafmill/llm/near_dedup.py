"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct five-word shingles.  One Arrow pass makes, of each whole text,
the size of the set, a digest of the set, MinHash samples hashed into bands of 5, and an odd sketch:
the samples folded into a bitmap of 512 parity bits.  The XOR of two odd sketches has a
population count that follows the number of samples in which the sets differ, and estimates high
similarities closely from 64 bytes a document.

  1. Documents with one set are a class; only the class's smallest id goes on.
  2. Representatives that share a band are candidates.  A bucket of up to SMALL members gives its
     pairs, a larger one a star around its smallest member.
  3. Candidates whose sizes or odd sketches rule the similarity out are dropped (the sketches differ in
     over MARGIN standard deviations more bits than at the threshold); the rest is confirmed on full sets.
  4. Links join into components.  Where a large bucket still holds several components, the pairs that
     lie across them are all tested as well, in blocks of members: the blocks' members travel, not
     their pairs, and a block is compared by population counts and exact intersections.  Blocks of the
     bucket's largest component meet only blocks of other members.

So every pair that shares a band is either confirmed or ruled out, or already in one component.  The number
of bands follows from the threshold, so that a pair at the threshold misses all of them with a probability
of MISSED at most: 26 bands (130 samples) at 0.85, 39 (195) at 0.80.

Edge cases: a text without words (or null, or empty) has an empty set and is linked with nothing; a
text of one to four words is one shingle; a null id is left out of links and is a component of its
own; ids are integers, others fail; rows that repeat an id are one vertex; an empty table gives no rows; very long
texts are blocks of their own; other columns are ignored.

Words are hashed under a key that is drawn for each run, so no text can be written to look like another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpoint, table, written
from leafmill.llm.components import components
from leafmill.llm.textbytes import LOWER, Block, arrow_bytes, blocks, distinct_sorted, mix, mix_int, new_key, shingles, word_hashes, words

WORDS, THRESHOLD = 5, 85
ROWS, SKETCH_BITS = 5, 512
#: Probability with which a pair at the threshold may share no band, and standard deviations that its sketches may differ beyond the mean.
MISSED, MARGIN = 2.5e-7, 5.5
#: Members up to which a bucket gives all its pairs, and members of a block of a larger one.
SMALL, BLOCK = 24, 256
#: Candidate ids up to which their list is broadcast to the scan (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold in hundredths: bands, and the most bits in which the odd sketches of a pair may differ."""

    threshold: int
    bands: int
    most_ones: int

    @property
    def samples(self) -> int:
        return self.bands * ROWS


def plan(threshold: int) -> Plan:
    t = threshold / 100
    bands = math.ceil(math.log(MISSED) / math.log1p(-(t**ROWS))) if t < 1 else 1
    samples, n = bands * ROWS, SKETCH_BITS
    # a pair at the threshold differs in d samples, each of which turns a bit in either sketch
    d, spread = samples * (1 - t), math.sqrt(samples * t * (1 - t))
    one, two = (1 - 2 / n) ** (2 * d), (1 - 4 / n) ** (2 * d)
    mean, folded = n / 2 * (1 - one), n / 4 * (1 - two) + n * n / 4 * (two - one * one)
    slope = -n * math.log1p(-2 / n) * one
    return Plan(threshold, bands, math.ceil(mean + MARGIN * math.sqrt(max(folded, 0) + (slope * spread) ** 2)))


def text_sets(block: Block, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and row offsets; the key is that of the run."""
    lower = Block(block.lo, block.hi, LOWER[block.data], block.offsets)
    w = words(lower)
    return distinct_sorted(*shingles(word_hashes(lower.data, w, key), w.rows, WORDS))


def signatures(by: Plan, key: int):
    factors = np.array([mix_int(k + 1) | 1 for k in range(by.samples)], np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (id, n, d0, d1, bands, sketch)."""
        for batch in batches:
            for b in blocks(batch.column(1)):
                values, rows = text_sets(b, key)
                n = np.diff(rows)
                full = np.flatnonzero(n)
                starts = rows[:-1][full]
                digest = np.zeros((2, b.rows), np.uint64)
                bands, sketch = np.zeros((len(full), by.bands), np.uint64), np.zeros((len(full), SKETCH_BITS // 64), np.uint64)
                if len(full):
                    for k in range(2):
                        digest[k, full] = np.add.reduceat(mix(values + np.uint64(k)), starts)
                    short, out = (values >> np.uint64(32)).astype(np.uint32), np.empty(len(values), np.uint32)
                    least = np.empty((len(full), by.samples), np.uint32)
                    for k in range(by.samples):
                        np.multiply(short, factors[k], out=out)
                        least[:, k] = np.minimum.reduceat(out, starts)
                    drawn = mix(least.astype(np.uint64) + (np.arange(by.samples, dtype=np.uint64) << np.uint64(32)))
                    bit = (np.arange(len(full)) * SKETCH_BITS)[:, None] + (drawn % np.uint64(SKETCH_BITS)).astype(np.int64)
                    odd = (np.bincount(bit.ravel(), minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
                    sketch = np.packbits(odd.reshape(len(full), SKETCH_BITS), axis=1).view(np.uint64)
                    for j in range(by.bands):
                        bands[:, j] = mix(sum((drawn[:, j * ROWS + i] * np.uint64(2 * i + 3) for i in range(ROWS)), np.full(len(full), j, np.uint64)))
                held = np.zeros(b.rows + 1, np.int32)
                held[full + 1] = 1
                held = np.cumsum(held, dtype=np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(held * np.int32(x.shape[1])), pa.array(x.ravel().view(np.int64))) for x in (bands, sketch))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.rows), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), *lists], names=["id", "n", "d0", "d1", "bands", "sketch"])

    return run


def may_link(a: str, b: str, by: Plan) -> Column:
    """Sizes and sketches allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    ones = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * small >= by.threshold * large) & (ones <= by.most_ones)


def confirm(threshold: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, text of a, text of b) to the pairs that are links."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                (x, x_rows), (y, y_rows) = ((np.concatenate(v), np.concatenate([[0], np.cumsum(np.concatenate(n))])) for v, n in (_column_sets(part.column(k), key) for k in (2, 3)))
                nx, ny = np.diff(x_rows), np.diff(y_rows)
                row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                order = np.argsort(row, kind="stable")
                union = np.diff(distinct_sorted(np.concatenate([x, y])[order], np.concatenate([[0], np.cumsum(nx + ny)]))[1])
                yield part.select(["a", "b"]).filter(pa.array(100 * (nx + ny - union) >= threshold * union))

    return run


def _column_sets(column: pa.Array, key: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = [text_sets(b, key) for b in blocks(column)]
    return [v for v, _ in found], [np.diff(r) for _, r in found]


def packed_sets(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (id, hashes), the set as bytes."""
        for batch in batches:
            for b in blocks(batch.column(1)):
                values, rows = text_sets(b, key)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.rows), arrow_bytes(values.view(np.uint8), rows * 8, pa.binary())], names=["id", "hashes"])

    return run


def block_links(by: Plan):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between different components of two blocks of a bucket's members."""
        bucket, lo, hi = key
        a, b = rows[rows["block"] == lo], rows[rows["block"] == hi]
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return out
        n, m = a["n"].to_numpy(), b["n"].to_numpy()
        test = (a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :]) & (100 * np.minimum.outer(n, m) >= by.threshold * np.maximum.outer(n, m))
        if lo == hi:
            test &= np.triu(np.ones(test.shape, bool), 1)
        p, q = (np.stack(x["sketch"].to_numpy()).view(np.uint64) for x in (a, b))
        ones = np.zeros(test.shape, np.int64)
        for k in range(p.shape[1]):
            ones += np.bitwise_count(p[:, k][:, None] ^ q[:, k][None, :])
        test &= ones <= by.most_ones
        p, q = (np.stack(x["bands"].to_numpy()) for x in (a, b))
        for k in range(by.bands):  # a pair is tested where it first meets
            same = p[:, k][:, None] == q[:, k][None, :]
            if (p[:, k] == bucket).all() and (q[:, k] == bucket).all():
                break
            test &= ~same
        if not test.any():
            return out
        sets = [np.frombuffer(x, np.uint64) for x in [*a["hashes"], *b["hashes"]]]
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        common = np.zeros(test.shape, np.float32)
        for c in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
            i, j = np.searchsorted(code, [c, c + 8192])
            grid = np.zeros((len(sets), 8192), np.float32)
            grid[owner[i:j], code[i:j] - c] = 1
            common += grid[: len(a)] @ grid[len(a) :].T
        i, j = np.nonzero(test & (100 * common >= by.threshold * (n[:, None] + m[None, :] - common)))
        return pd.DataFrame({"a": a["id"].to_numpy()[i], "b": b["id"].to_numpy()[j]})

    return run


def text_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the given ids; the list is broadcast only when it is known to be short."""
    ids = checkpoint(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def across(met: DataFrame) -> DataFrame:
    """(bucket, id, component) to the members of mixed buckets, once for each pair (lo, hi) of blocks that they take part in.

    The largest component of a bucket has blocks of its own, and no two of these meet, since a pair
    inside one component need not be tested.  So a bucket of one large component and some other members
    grows with its size, not with its square.
    """
    parts = met.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = F.col("main.size")
    cuts = mixed.select("bucket", F.col("main.component").alias("main"), *(F.ceil(size / BLOCK).cast("int").alias(name) for name, size in (("inner", main), ("outer", F.col("members") - main))))
    own = met.join(cuts, "bucket").withColumn("inside", F.col("component") == F.col("main"))
    # blocks below `outer` hold the other members, the rest the largest component
    own = own.withColumn("block", F.when(F.col("inside"), F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int"))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return own.select("bucket", "id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def links(docs: DataFrame, signed: DataFrame, by: Plan, key: int) -> DataFrame:
    """Pairs (a, b) whose components are those of all links; docs has id and text, signed one row of each class."""
    met = signed.select("id", F.explode("bands").alias("bucket"))
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).where("members > 1")
    met = checkpoint(met.join(crowded, "bucket"))
    few, many = met.where(F.col("members") <= SMALL).select("bucket", "id"), met.where(F.col("members") > SMALL)
    pairs = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "bucket").where("a < b").select("a", "b")
    pairs = pairs.union(many.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b"))).distinct()
    light = signed.select("id", "n", "sketch")
    x, y = light.alias("x"), light.alias("y")
    pairs = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(may_link("x", "y", by)).select("a", "b")
    pairs = checkpoint(pairs)
    texts = text_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = checkpoint(both.select("a", "b", "text_a", "text_b").mapInArrow(confirm(by.threshold, key), "a long, b long"))
    if many.isEmpty():
        return found
    first = components(found)
    many = many.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = checkpoint(across(many))
    if rest.isEmpty():
        return found
    sets = text_of(docs, rest.select("id")).mapInArrow(packed_sets(key), "id long, hashes binary")
    rest = rest.join(signed.select("id", "n", "sketch", "bands"), "id").join(sets, "id")
    more = rest.groupBy("bucket", "lo", "hi").applyInPandas(block_links(by), "a long, b long")
    return found.unionByName(checkpoint(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, component_id and kept of every row; threshold in hundredths."""
    by, secret = plan(threshold), new_key()
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = written(docs.mapInArrow(signatures(by, secret), "id long, n long, d0 long, d1 long, bands array<long>, sketch array<long>"), "signatures")
    classes = signed.where("n > 0 and id is not null").groupBy("d0", "d1", "n").agg(F.min("id").alias("rep"))
    member = signed.select("id", "n", "d0", "d1").join(classes, ["d0", "d1", "n"], "left").select("id", "n", F.coalesce(F.when(F.col("id").isNotNull(), F.col("rep")), F.col("id")).alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    twice = reps.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    if not twice.isEmpty():  # of rows that repeat an id with different texts the smallest one speaks
        smallest = reps.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("n", "d0", "d1", "bands", "sketch")).alias("s")).select("id", "s.*")
        reps = reps.join(twice, "id", "left_anti").unionByName(smallest.select(*reps.columns))
    joined = components(links(docs.where("id is not null"), reps, by, secret))
    out = member.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op9_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_minhash_odd_sketch": op9_minhash_odd_sketch}
ORACLES: dict[str, str] = {}
