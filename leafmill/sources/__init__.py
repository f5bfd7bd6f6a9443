"""leafmill.sources"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input bytes for each core below which a table is dealt out before heavy work.
SMALL_SHARE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out to all cores.

    A file of one row group is one task however many cores there are.  Moving such a table is cheap; a table of
    more than SMALL_SHARE bytes for each core has tasks enough and is left where it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SMALL_SHARE * cores else df
