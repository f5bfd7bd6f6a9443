"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, about.
BLOCK = 512


def _blocked(vectors: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row for each block of about BLOCK vectors: ids, and their numbers end to end."""
    block = F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(blocks)).alias(name)
    listed = vectors.groupBy(block).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return listed.select(name, F.transform("rows", lambda r: r["vec_id"]).alias(f"{name}_ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias(f"{name}_v"))


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k vectors of the largest cosine for each query, itself left out: query_id, vec_id, score (6 digits), rank.

    queries and vectors: vec_id and v (array of numbers).  Blocks of queries meet blocks of vectors by an
    equi-join on the block's number; a pair of blocks is one matrix product, of which each query keeps its k
    best (ties by id), so what is shuffled afterwards is k rows for each query and block.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    q = _blocked(queries, max(1, -(-n_queries // BLOCK)), "q")
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, -(-n_queries // BLOCK)) - 1).cast("bigint")))
    pairs = _blocked(vectors, max(1, -(-n_vectors // BLOCK)), "r").withColumn("q", numbers).join(q, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_v, r_ids, r_v = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("q_ids", "q_v", "r_ids", "r_v"))
                a, b = q_v.astype(float).reshape(len(q_ids), -1), r_v.astype(float).reshape(len(r_ids), -1)
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
                score = np.round(a @ b.T, 6)
                score[q_ids[:, None] == r_ids[None, :]] = -np.inf
                by_id = np.argsort(r_ids, kind="stable")
                best = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(score, best, axis=1)
                good = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, best.shape[1])[good.ravel()]), pa.array(r_ids[best][good]), pa.array(found[good])], names=["query_id", "vec_id", "score"])

    near = pairs.select("q_ids", "q_v", "r_ids", "r_v").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
