"""Dense indexes of names, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusmill.scratch import Scratch


def dense_index(df: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """df with idx, its rows' places in the given order, from `first` on.

    The rows are dealt out by range; each part numbers its own from where the parts before end, which a table of one
    count per part tells.
    """
    scratch = Scratch(df.sparkSession, "index")
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part_", before.alias("before_"))
    own = dealt.withColumn("rn_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    return own.join(starts, "part_").withColumn("idx", F.col("before_") + F.col("rn_") - 1 + first).drop("part_", "rn_", "before_")


def features(annotation: DataFrame, no_feature: str = "__no_feature") -> DataFrame:
    """(locus, fid): loci in order from 1 on, and the reserved name as 0."""
    index = dense_index(annotation.select("locus").distinct(), ["locus"], 1)
    return index.select("locus", F.col("idx").cast("long").alias("fid")).union(annotation.sparkSession.sql(f"SELECT '{no_feature}', 0L"))
