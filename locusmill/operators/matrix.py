"""Kernels on sparse matrices held as rows (rid, fid, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.operators.dealing import deal


#: Copies of a row that are made at a time.
TURN = 65_536


def row():
    return Window.partitionBy("rid")


def score_matrix(alignments: DataFrame) -> DataFrame:
    """Scores (rid, fid, raw) of alignments (rid, fid, sc, len): the largest of sc - least sc + 1 + len per cell.

    Only rows that hit a feature other than the reserved 0 are kept, with all their cells.
    """
    least = alignments.agg(F.min("sc")).scalar()
    cells = deal(alignments.select("rid", "fid", (F.col("sc") + F.col("len")).alias("top")), "rid").groupBy("rid", "fid").agg(F.max("top").alias("top"))
    hit = F.max(F.when(F.col("fid") > 0, 1).otherwise(0)).over(row())
    return cells.withColumn("hit", hit).where("hit = 1").select("rid", "fid", (F.col("top") - least + 1).cast("long").alias("raw"))


def total(m: DataFrame, value: str, how=F.sum) -> Column:
    """A scalar over the whole matrix."""
    return m.agg(how(value)).scalar()


def norm(m: DataFrame, axis: int | None = None, value: str = "raw") -> DataFrame:
    """Values over their total (axis None) or over their row's sum (axis 1); rows that sum to 0 stay 0."""
    whole = total(m, value) if axis is None else F.sum(value).over(row())
    return m.select("rid", "fid", F.coalesce(F.try_divide(F.col(value).cast("double"), whole.cast("double")), F.lit(0.0)).alias("value"))


def scale(m: DataFrame, axis: int | None = None, value: str = "raw") -> DataFrame:
    """Values over the largest of all (axis None) or of their row (axis 1)."""
    most = total(m, value, F.max) if axis is None else F.max(value).over(row())
    return m.select("rid", "fid", F.coalesce(F.try_divide(F.col(value).cast("double"), most.cast("double")), F.lit(0.0)).alias("value"))


def binmax(m: DataFrame, axis: int | None = None, value: str = "raw") -> DataFrame:
    """Cells that hold the largest value of all or of their row, all ties, as 1."""
    most = total(m, value, F.max) if axis is None else F.max(value).over(row())
    return m.where(F.col(value) != 0).withColumn("most", most).where(F.col(value) == F.col("most")).select("rid", "fid", F.lit(1).alias("value"))


def row_nnz(m: DataFrame) -> DataFrame:
    return m.groupBy("rid").agg(F.count(F.lit(1)).alias("nnz"))


def row_sums(m: DataFrame, value: str = "raw") -> DataFrame:
    return m.groupBy("rid").agg(F.sum(value).alias("total"), F.max(value).alias("most"))


def colsums(m: DataFrame, value: str = "raw") -> DataFrame:
    return m.groupBy("fid").agg(F.sum(value).alias("total"))


def groupby_sum(m: DataFrame, groups: DataFrame, by: str, value: str = "raw") -> DataFrame:
    """Sums per (group, fid), groups mapping rid to `by`; rows that it lacks belong to no group."""
    return m.join(groups.select("rid", by), "rid").groupBy(by, "fid").agg(F.sum(value).alias("total"))


def select_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("rid").distinct(), "rid", "left_semi")


def exclude_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("rid").distinct(), "rid", "left_anti")


def choose_random(m: DataFrame, seed: int) -> DataFrame:
    """One cell of each row, evenly by a hash of seed, row and column."""
    w = row().orderBy(F.xxhash64(F.lit(seed), "rid", "fid"), "fid")
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def multiply(m: DataFrame, factor: DataFrame, on: list[str], value: str = "value", by: str = "factor") -> DataFrame:
    """Element-wise or broadcast product; cells without a factor vanish."""
    return m.join(factor, on).withColumn(value, F.col(value) * F.col(by)).drop(by)


def apply_values(m: DataFrame, change, value: str = "value") -> DataFrame:
    """A function of columns on the stored values."""
    return m.withColumn(value, change(F.col(value)))


def eliminate_zeros(m: DataFrame, value: str = "value") -> DataFrame:
    return m.where(F.col(value) != 0)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, as often as it does; empty for equal matrices."""
    both = a.withColumn("n_", F.lit(1)).union(b.withColumn("n_", F.lit(-1)))
    per = deal(both, *a.columns).groupBy(*a.columns).agg(F.sum("n_").alias("n_")).where("n_ <> 0")
    turns = per.withColumn("from_", F.explode(F.sequence(F.lit(0), F.abs("n_") - 1, F.lit(TURN))))
    rows = turns.withColumn("at_", F.explode(F.sequence(F.lit(1), F.least(F.abs("n_") - F.col("from_"), F.lit(TURN)))))
    return rows.select(*a.columns, F.when(F.col("n_") > 0, "left").otherwise("right").alias("side"))


def weights(m: DataFrame) -> DataFrame:
    """Logarithm of expm1(100 raw / most), lq, without the overflow of its parts; pools, if there, have their own most."""
    most = total(m, "raw", F.max) if "pool" not in m.columns else F.max("raw").over(Window.partitionBy("pool"))
    t = F.lit(100.0) * F.col("raw") / most
    return m.withColumn("t", t).withColumn("lq", F.col("t") + F.log1p(-F.exp(-F.col("t")))).drop("t")


def top_scores(m: DataFrame) -> DataFrame:
    """The cells that hold their row's largest value."""
    return m.withColumn("most_", F.max("raw").over(row())).where("raw = most_").drop("most_")


def complement(vector: DataFrame, index: DataFrame, key: str = "rid") -> DataFrame:
    """Of a 0/1 vector (key, value) over an index, 1 where it is 0 or missing: (key, value), all places."""
    return index.select(key).join(vector.select(key, F.col("value").alias("v_")), key, "left").select(key, F.when(F.coalesce("v_", F.lit(0)) == 0, 1).otherwise(0).alias("value"))
