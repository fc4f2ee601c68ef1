"""Reassignment of ambiguous rows under seven policies, and counts per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("best_exclude", "best_random", "best_average", "best_conf", "initial_unique", "initial_random", "total_hits")
#: Older names of the modes.
ALIASES = {"exclude": "best_exclude", "choose": "best_random", "average": "best_average", "conf": "best_conf", "unique": "initial_unique"}
def row():
    return Window.partitionBy("rid")

#: Decimals to which posteriors are compared for ties.
TIE_DIGITS = 10


def best(z: DataFrame, value: str, digits: int | None) -> DataFrame:
    """Cells that hold their row's largest value, all ties, with their number nbest."""
    v = F.round(value, digits) if digits is not None else F.col(value)
    top = z.where(F.col(value) > 0).withColumn("v_", v).withColumn("m_", F.max("v_").over(row())).where("v_ = m_")
    return top.withColumn("nbest", F.count(F.lit(1)).over(row())).drop("v_", "m_")


def reassign(cells: DataFrame, mode: str, threshold: float = 0.9, seed: int = 0) -> DataFrame:
    """Assignments (rid, fid, w) of cells (rid, fid, raw and, for best_*, z) under a mode."""
    mode = ALIASES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "best_conf":
        return cells.where(F.col("z") > threshold).select("rid", "fid", F.lit(1.0).alias("w"))
    if mode == "total_hits":
        return cells.where("raw > 0").select("rid", "fid", F.lit(1.0).alias("w"))
    if mode == "initial_unique":
        one = cells.where("raw > 0").withColumn("nnz", F.count(F.lit(1)).over(row()))
        return one.where("nnz = 1").select("rid", "fid", F.lit(1.0).alias("w"))
    top = best(cells, "raw", None) if mode == "initial_random" else best(cells, "z", TIE_DIGITS)
    if mode == "best_exclude":
        return top.where("nbest = 1").select("rid", "fid", F.lit(1.0).alias("w"))
    if mode == "best_average":
        return top.select("rid", "fid", (F.lit(1.0) / F.col("nbest")).alias("w"))
    pick = F.row_number().over(row().orderBy(F.xxhash64(F.lit(seed), "rid", "fid"), "fid"))
    return top.withColumn("rn", pick).where("rn = 1").select("rid", "fid", F.lit(1.0).alias("w"))


def initial_best(cells: DataFrame) -> DataFrame:
    """initial_random with ties resolved by the smallest feature."""
    pick = F.row_number().over(row().orderBy("fid"))
    return best(cells, "raw", None).withColumn("rn", pick).where("rn = 1").select("rid", "fid", F.lit(1.0).alias("w"))


def summary(cells: DataFrame, mode: str, rows: int | None = None, threshold: float = 0.9) -> DataFrame:
    """One row: mode, assigned, ambiguous, unaligned; rows counts those without any cell too."""
    mode = ALIASES.get(mode, mode)
    if mode == "best_conf":
        per = cells.groupBy("rid").agg(F.max("z").alias("m"))
        agg = per.agg(F.count_if(F.col("m") > threshold).alias("assigned"), F.count_if((F.col("m") > 0) & (F.col("m") <= threshold)).alias("ambiguous"), F.count_if(F.col("m") > 0).alias("seen"))
    elif mode in ("initial_unique", "total_hits"):
        per = cells.where("raw > 0").groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
        assigned = F.count_if(F.col("n") == 1) if mode == "initial_unique" else F.sum("n")
        agg = per.agg(assigned.alias("assigned"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count(F.lit(1)).alias("seen"))
    else:
        per = best(cells, "raw" if mode == "initial_random" else "z", None if mode == "initial_random" else TIE_DIGITS).groupBy("rid").agg(F.first("nbest").alias("n"))
        agg = per.agg(F.count_if(F.col("n") == 1).alias("assigned"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count(F.lit(1)).alias("seen"))
    n = F.lit(rows).cast("long") if rows is not None else cells.agg(F.countDistinct("rid")).scalar()
    return agg.select(F.lit(mode).alias("mode"), F.col("assigned").cast("long").alias("assigned"), "ambiguous", (n - F.col("seen")).cast("long").alias("unaligned"))


def counts_by_cell(assigned: DataFrame, reads: DataFrame) -> DataFrame:
    """Summed weights per (bc, fid)."""
    return assigned.join(reads.select("rid", "bc"), "rid").groupBy("bc", "fid").agg(F.sum("w").alias("n"))


def umi_counts_by_cell(assigned: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct molecules per (bc, fid)."""
    return assigned.where("w > 0").join(reads.select("rid", "bc", "umi"), "rid").groupBy("bc", "fid").agg(F.countDistinct("umi").alias("n"))


def complete_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Every listed cell with its counts, (bc, null, 0) where it has none."""
    return cells.select("bc").join(counts, "bc", "left").select("bc", "fid", F.coalesce("n", F.lit(0)).alias("n"))


def merge_counts(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """Two count tables (bc, fid, n) over the cells that both have; b's features come after a's, `offset` on."""
    both = a.select("bc").distinct().join(b.select("bc").distinct(), "bc")
    return a.unionByName(b.withColumn("fid", F.col("fid") + offset)).join(both, "bc", "left_semi")
