"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from locusmill.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_locusmill_scratch", None):
        sc._locusmill_scratch = f"file://{tempfile.mkdtemp(prefix='locusmill-scratch-')}"
    return sc._locusmill_scratch


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        sc = spark.sparkContext
        sc._locusmill_bases = [*getattr(sc, "_locusmill_bases", []), self.base]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.base}/{name}")


def remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Remove all tables that this application has written to the shared folder; results that were read from them end.

    For the end of a run, whose outputs are elsewhere. Gives the number of folders.
    """
    bases = getattr(spark.sparkContext, "_locusmill_bases", [])
    for base in bases:
        remove(spark, base)
    spark.sparkContext._locusmill_bases = []
    return len(bases)
