"""Stand-ins on the star-schema tables for alignments, reads, scores, exons and blocks, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.operators.matrix import score_matrix
from locusmill.session import ship

#: Number of features, the reserved one (0) included.
K = 41


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("bc"), F.col("o_orderpriority").alias("umi"), F.col("c_mktsegment").alias("celltype"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % K).alias("fid"), F.col("l_quantity").cast("int").alias("sc"), (20 + F.col("l_suppkey") % 30).cast("int").alias("len"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return score_matrix(alignments(spark, d))


def exons(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.col("p_type").alias("locus"),
        (F.col("p_size") % 5).cast("long").alias("chrom"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("p_partkey") * 3).alias("iv_start"),
        (F.col("p_partkey") * 3 + 10 + F.col("p_size") + 1).alias("iv_end"),
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start = F.col("l_partkey") * 3 + F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("rid"),
        F.col("l_linenumber").alias("ln"),
        (F.col("l_suppkey") % 5).alias("chrom"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        start.alias("b_start"),
        (start + F.col("l_quantity").cast("int")).alias("b_end"),
    )


#: The same relations for DuckDB; iv_end and b_end are exclusive.
CTES = """
st_reads AS (SELECT o_orderkey rid, o_custkey bc, o_orderpriority umi, c_mktsegment celltype FROM orders JOIN customer ON o_custkey = c_custkey),
st_aln AS (SELECT l_orderkey rid, l_linenumber ln, l_partkey % 41 fid, CAST(l_quantity AS INT) sc, CAST(20 + l_suppkey % 30 AS INT) len FROM lineitem),
st_scores AS (SELECT a.rid, a.fid, CAST(MAX(a.sc - m.mn + 1 + a.len) AS BIGINT) raw FROM st_aln a CROSS JOIN (SELECT MIN(sc) mn FROM st_aln) m
  WHERE a.rid IN (SELECT rid FROM st_aln WHERE fid > 0) GROUP BY a.rid, a.fid),
st_exons AS (SELECT p_type locus, CAST(p_size % 5 AS BIGINT) chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END strand,
  p_partkey * 3 iv_start, p_partkey * 3 + 10 + p_size + 1 iv_end FROM part),
st_blocks AS (SELECT l_orderkey rid, l_linenumber ln, l_suppkey % 5 chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END strand,
  l_partkey * 3 + l_linenumber b_start, l_partkey * 3 + l_linenumber + CAST(l_quantity AS INT) b_end FROM lineitem)
"""


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CTES.strip(), *(c.strip() for c in ctes)]) + "\n" + select
