"""Reading tables and keeping intermediate results, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a folder of our own serves a session on one machine (master local); on a cluster it
    is an error, since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = Path(tempfile.mkdtemp(prefix="leafmill-")).as_uri()
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a compact checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key, remainders: int = 3):
    """crc32 of the key as text, modulo ``remainders``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(remainders), F.lit(0))


#: Labels of a column that a fit accepts; more of them are an error, since labels are few.
LABELS = 10_000


def label_counts(df: DataFrame, group: str, most: int = LABELS) -> dict:
    """Rows of each label but null; a column of more than ``most`` labels is refused."""
    found = df.where(F.col(group).isNotNull()).groupBy(group).count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{group} has more than {most} different labels")
    return {r[group]: r["count"] for r in sorted(found, key=lambda r: r[group])}


def spread(seed: str, *columns) -> Column:
    """A number from 0 to 2**63 - 1 that follows from the columns and looks random."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c in columns)), 1)


def threshold(wanted: float, count: int) -> int:
    """Below this spread() lie about ``wanted`` of ``count`` rows, however many there are."""
    return 2**63 - 1 if wanted >= count else max(int(2**63 * wanted) // max(int(count), 1), 1)


def bounded_sample(df: DataFrame, counts: dict, key: str, group: str, per_group: int, seed: str) -> DataFrame:
    """The ``per_group`` rows of each group with the smallest hashes (all rows of a smaller group).

    counts: rows of each group, see label_counts(); other groups give none.  The scan thins each group to
    about twice what is wanted, a window with a limit does the rest, so no more than per_group rows a group are
    left, also where rows repeat; equal rows come all or none.  The same rows give the same sample however they are partitioned.
    """
    spark = df.sparkSession
    if not counts:
        return df.limit(0)
    label, at, below = unused(df, "_label"), unused(df, "_at"), unused(df, "_below")
    limits = spark.createDataFrame([(g, threshold(2 * per_group + 50, n)) for g, n in counts.items()], f"{label} {df.schema[group].dataType.simpleString()}, {below} long")
    thinned = df.withColumn(at, spread(seed, key, *(c for c in df.columns if c != key))).join(F.broadcast(limits), F.col(group) == F.col(label)).where(F.col(at) <= F.col(below))
    order = Window.partitionBy(label).orderBy(at, *(c for c in df.columns if c not in (at, label)))
    rank = unused(df, "_rank")
    return thinned.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= per_group).select(*df.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of df is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
