"""Hilbert-curve sharding: order rows along a curve through several metadata dimensions and cut runs.

Three dimensions are quantised to 4 bits each: the source, the language and the logarithm of the
size.  A cell of this 16 x 16 x 16 grid has an index on the three-dimensional Hilbert curve, so
neighbours on the curve are neighbours in every dimension, and a shard, a run of the curve, spans a
small box of the metadata space that a reader can prune by.

Equal texts form a group.  A group of one source and language lies in its cell like any row.  A group of several
ones takes the cell of its first labels in a trailing run: the curve once more, after its end, for such groups
alone.  So a group's rows are neighbours and lie in one shard unless one of the cuts that the law fixes falls into
it, and no other shard holds rows of a foreign source or language; only the shards at the end span all of them.

The law is ``rows``: shard k of n holds ranks floor(k*N/n) to floor((k+1)*N/n), so counts differ by one
at most.  Ranks are global without sorting everything in one task: each curve cell is divided into
4,096 sub-cells by checksum, a sub-cell by checksum, and the rows of one checksum by a hash of the key into
64 parts, so one hot cell or one repeated text is divided, too.  A rank is the number of rows in earlier cells,
in earlier sub-cells of the cell, in earlier parts of the sub-cell, and before the row in its part.

Only DataFrame functions are used.

Edge cases: a null text has no bytes (size 8) and the checksum of the empty text; null source and
language are a value of their own; repeated rows each get a place of their own (ties are ordered by
key, then by the remaining order of the rows, which does not affect the law); an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import table

BITS, DIMENSIONS = 4, 3
CELLS = 1 << (BITS * DIMENSIONS)


def curve(spark: SparkSession) -> DataFrame:
    """All cells of the grid with their place on the Hilbert curve: columns cell, at.

    The cell number is the three coordinates, 4 bits each.  The place follows from Skilling's
    transform of the coordinates (AIP Conf. Proc. 707, 2004), a few bit operations per level.
    """
    zero = F.lit(0).cast("bigint")
    bit = lambda v, level: F.call_function("shiftright", v, level).bitwiseAND(F.lit(1))
    low = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1
    levels = F.array(*(F.lit(k) for k in range(BITS - 1, 0, -1)))
    steps = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(k).alias("k")) for level in range(BITS - 1, 0, -1) for k in range(DIMENSIONS)))

    def turned(x: Column, step: Column) -> Column:
        mine, level = F.element_at(x, step["k"] + 1), step["level"]
        swap = x[0].bitwiseXOR(mine).bitwiseAND(low(level))
        mirrored = F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low(level))).otherwise(v))
        swapped = F.transform(x, lambda v, i: F.when((step["k"] > 0) & ((i == 0) | (i == step["k"])), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(bit(mine, level) == 1, mirrored).otherwise(swapped)

    axes = F.array(*(F.expr(f"shiftright(id, {BITS * (DIMENSIONS - 1 - k)}) & {(1 << BITS) - 1}") for k in range(DIMENSIONS)))
    df = spark.range(CELLS).select(F.col("id").alias("cell"), F.aggregate(steps, axes, turned).alias("x"))
    gray = F.transform(F.sequence(F.lit(1), F.lit(DIMENSIONS)), lambda k: F.aggregate(F.slice("x", F.lit(1), k), zero, lambda a, v: a.bitwiseXOR(v)))
    df = df.select("cell", gray.alias("x"))
    flip = F.aggregate(levels, zero, lambda a, level: F.when(bit(F.element_at("x", -1), level) == 1, a.bitwiseXOR(low(level))).otherwise(a))
    df = df.select("cell", F.transform("x", lambda v: v.bitwiseXOR(flip)).alias("x"))
    order = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(k).alias("k")) for level in range(BITS - 1, -1, -1) for k in range(DIMENSIONS)))
    at = F.aggregate(order, zero, lambda a, s: a * 2 + bit(F.element_at("x", s["k"] + 1), s["level"]))
    return df.select("cell", at.alias("at"))


def quantised(size: Column, *labels: Column) -> Column:
    """The cell of a row: two labels hashed to 4 bits each, and the size's octave, 16 of them from 16 bytes on."""
    octave = F.greatest(F.lit(0), F.least(F.lit(15), F.floor(F.log2(size.cast("double"))) - 4)).cast("bigint")
    cell = F.lit(0).cast("bigint")
    for label in labels:
        cell = cell * 16 + F.pmod(F.xxhash64(label), F.lit(16))
    return cell * 16 + octave


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", labels: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row; see the module's text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("crc"),
        F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"label{k}") for k, c in enumerate(labels))).alias("labels"),
    )
    groups = rows.groupBy("size", "crc").agg(F.min("labels").alias("first"), F.max("labels").alias("last")).where("first <> last").drop("last")
    rows = rows.join(groups, ["size", "crc"], "left").withColumn("mixed", F.col("first").isNotNull()).withColumn("labels", F.coalesce("first", "labels"))
    rows = rows.select(
        "key", "size", "crc", "mixed", quantised(F.col("size"), F.col("labels.label1"), F.col("labels.label0")).alias("cell"),
        F.shiftright("crc", 20).alias("sub"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("part"),
    )
    rows = rows.join(F.broadcast(curve(docs.sparkSession)), "cell").drop("cell")
    rows = rows.withColumn("at", F.col("at") + F.when(F.col("mixed"), CELLS).otherwise(0)).drop("mixed")
    parts = rows.groupBy("at", "sub", "crc", "size", "part").count()
    subs = parts.groupBy("at", "sub").agg(F.sum("count").alias("count"))
    inside = subs.withColumn("in_cell", F.sum("count").over(Window.partitionBy("at").orderBy("sub")) - F.col("count"))
    cells = subs.groupBy("at").agg(F.sum("count").alias("n"))
    # 8,192 rows at most, whatever the input
    before = cells.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    offsets = inside.join(F.broadcast(before), "at").select("at", "sub", (F.col("in_cell") + F.col("before")).alias("offset"), "total")
    in_sub = F.sum("count").over(Window.partitionBy("at", "sub").orderBy("crc", "size", "part")) - F.col("count")
    placed = parts.withColumn("in_sub", in_sub).join(offsets, ["at", "sub"]).select("at", "sub", "crc", "size", "part", (F.col("offset") + F.col("in_sub")).alias("start"), "total")
    place = F.row_number().over(Window.partitionBy("at", "sub", "crc", "size", "part").orderBy("key")) - 1
    ranked = rows.withColumn("place", place).join(placed, ["at", "sub", "crc", "size", "part"]).withColumn("rank", F.col("start") + F.col("place"))
    # rank r lies in shard k where floor(k*N/n) <= r < floor((k+1)*N/n)
    ranked = ranked.withColumn("shard", F.expr(f"int(((rank + 1) * {shards} - 1) div total)"))
    slot = F.col("rank") - F.expr(f"(shard * total) div {shards}")
    return ranked.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("at").cast("int").alias("curve_at"),
    )


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op5_hilbert_shards": op5_hilbert_shards}
ORACLES: dict[str, str] = {}
