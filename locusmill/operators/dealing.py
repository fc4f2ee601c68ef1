"""Shuffles into as many parts as the input needs, so that a task's rows stay as many when the input grows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of source tables for one part; columns of numbers take about a million rows at most.
PART_BYTES = 8 << 20
#: Parts at most, and from which size on a source's is an unknown one.
MOST, UNKNOWN = 4096, 1 << 50


def parts(df: DataFrame) -> int:
    """Parts for a shuffle of df, by the sizes of the tables that it is read from; the session's number if one is unknown.

    Adaptive execution joins parts by their compressed bytes: of a few numbers a row, many millions of rows would be one task's.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    spark = df.sparkSession
    if any(s >= UNKNOWN for s in sizes):
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(-(-sum(sizes) // PART_BYTES), MOST))


def deal(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df with the rows of a key in one part, in n parts or as many as it needs."""
    return df.repartition(n or parts(df), *keys)
