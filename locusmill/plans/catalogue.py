"""All queries of the engine on the stand-in tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.functions import scalars
from locusmill.operators import em, fragments, intervals, matrix, reassign, umi
from locusmill.plans import standins as st
from locusmill.plans.standins import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE[name or f.__name__] = oracle
        return f

    return add


# Matrix kernels


@query(sql("SELECT rid, fid, raw FROM st_scores"))
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    return st.scores(spark, d)


def rounded(m: DataFrame, column: str = "value", digits: int = 9) -> DataFrame:
    return m.withColumn(column, F.round(column, digits))


for _name, _op, _sql in (
    ("norm_total", lambda m: matrix.norm(m), "raw / SUM(raw) OVER ()"),
    ("norm_row", lambda m: matrix.norm(m, 1), "raw / SUM(raw) OVER (PARTITION BY rid)"),
    ("scale_max", lambda m: matrix.scale(m), "raw / MAX(raw) OVER ()"),
    ("scale_row", lambda m: matrix.scale(m, 1), "raw / MAX(raw) OVER (PARTITION BY rid)"),
):
    query(sql(f"SELECT rid, fid, ROUND(CAST({_sql} AS DOUBLE), 9) AS value FROM st_scores"), _name)(lambda spark, d, op=_op: rounded(op(st.scores(spark, d))))


@query(sql("SELECT rid, fid, 1 AS value FROM st_scores WHERE raw = (SELECT MAX(raw) FROM st_scores)"))
def binmax_all(spark: SparkSession, d: str) -> DataFrame:
    return matrix.binmax(st.scores(spark, d))


@query(sql("SELECT rid, fid, 1 AS value FROM (SELECT *, MAX(raw) OVER (PARTITION BY rid) m FROM st_scores) WHERE raw = m"))
def binmax_row(spark: SparkSession, d: str) -> DataFrame:
    return matrix.binmax(st.scores(spark, d), 1)


@query(sql("SELECT rid, COUNT(*) AS nnz FROM st_scores GROUP BY rid"))
def row_nnz(spark: SparkSession, d: str) -> DataFrame:
    return matrix.row_nnz(st.scores(spark, d))


@query(sql("SELECT rid, CAST(SUM(raw) AS BIGINT) AS total, MAX(raw) AS most FROM st_scores GROUP BY rid"))
def row_sums(spark: SparkSession, d: str) -> DataFrame:
    return matrix.row_sums(st.scores(spark, d))


@query(sql("SELECT fid, CAST(SUM(raw) AS BIGINT) AS total FROM st_scores GROUP BY fid"))
def colsums(spark: SparkSession, d: str) -> DataFrame:
    return matrix.colsums(st.scores(spark, d))


@query(sql("SELECT celltype, fid, CAST(SUM(raw) AS BIGINT) AS total FROM st_scores JOIN st_reads USING (rid) GROUP BY celltype, fid"))
def groupby_sum_celltype(spark: SparkSession, d: str) -> DataFrame:
    return matrix.groupby_sum(st.scores(spark, d), st.reads(spark, d), "celltype")


def chosen_reads(spark: SparkSession, d: str) -> DataFrame:
    few = st.table(spark, d, "customer").where("c_nationkey IN (3, 7)").select(F.col("c_custkey").alias("bc"))
    return st.reads(spark, d).join(few, "bc", "left_semi")


CHOSEN = "chosen AS (SELECT rid FROM st_reads WHERE bc IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)))"


@query(sql("SELECT rid, fid, raw FROM st_scores WHERE rid IN (SELECT rid FROM chosen)", CHOSEN))
def row_select(spark: SparkSession, d: str) -> DataFrame:
    return matrix.select_rows(st.scores(spark, d), chosen_reads(spark, d))


@query(sql("SELECT rid, fid, raw FROM st_scores WHERE rid NOT IN (SELECT rid FROM chosen)", CHOSEN))
def row_exclude(spark: SparkSession, d: str) -> DataFrame:
    return matrix.exclude_rows(st.scores(spark, d), chosen_reads(spark, d))


@query(sql("SELECT rid, fid, ROUND(100.0::DOUBLE * raw / m + LN(1 - EXP(-100.0::DOUBLE * raw / m)), 9) AS lq FROM st_scores, (SELECT MAX(raw) m FROM st_scores)"))
def weights_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.weights(st.scores(spark, d)), "lq").select("rid", "fid", "lq")


@query(sql("SELECT rid, fid, ROUND(CAST(raw * 1.0 / t AS DOUBLE), 9) AS value FROM st_scores JOIN (SELECT fid, SUM(raw) t FROM st_scores GROUP BY fid) USING (fid)"))
def multiply_columns(spark: SparkSession, d: str) -> DataFrame:
    m = st.scores(spark, d)
    factor = matrix.colsums(m).select("fid", (1.0 / F.col("total")).alias("factor"))
    return rounded(matrix.multiply(m.select("rid", "fid", F.col("raw").cast("double").alias("value")), factor, ["fid"]).select("rid", "fid", "value"))


@query(sql("SELECT rid, fid, raw, CASE WHEN fid % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM st_scores WHERE fid IN (2, 3)"))
def matrix_differences(spark: SparkSession, d: str) -> DataFrame:
    m = st.scores(spark, d)
    return matrix.differences(m.where("fid <> 3"), m.where("fid <> 2"))


# Intervals


def islands(by: str, source: str = "st_exons", distance: int = 1, extra: str = "") -> str:
    return f"""islands AS (SELECT {by}, MIN(iv_start) iv_start, MAX(iv_end) iv_end FROM (
  SELECT *, SUM(fresh) OVER (PARTITION BY {by} ORDER BY iv_start, iv_end ROWS UNBOUNDED PRECEDING) island FROM (
    SELECT *, CASE WHEN iv_start - MAX(iv_end) OVER (PARTITION BY {by} ORDER BY iv_start, iv_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {distance} THEN 0 ELSE 1 END fresh
    FROM {source})) GROUP BY {by}, island)"""


LOCUS = "locus, chrom"
STRANDED = "locus, chrom, strand"


@query(sql(f"SELECT {LOCUS}, iv_start, iv_end FROM islands", islands(LOCUS)))
def merge_exons(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_intervals(st.exons(spark, d), ["locus", "chrom"])


@query(sql(f"SELECT {STRANDED}, iv_start, iv_end FROM islands", islands(STRANDED)))
def merge_exons_stranded(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_intervals(st.exons(spark, d), ["locus", "chrom", "strand"])


@query(sql("SELECT locus, CAST(SUM(iv_end - iv_start - 1) AS BIGINT) AS length FROM islands GROUP BY locus", islands(LOCUS)))
def feature_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.feature_length(merge_exons(spark, d))


@query(
    sql(
        "SELECT (SELECT COUNT(DISTINCT locus) FROM islands) AS num_loci, (SELECT COUNT(*) FROM islands) AS num_intervals, (SELECT COUNT(DISTINCT chrom) FROM islands) AS num_refs, (SELECT CAST(SUM(iv_end - iv_start) AS BIGINT) FROM merged) AS union_length",
        islands(LOCUS),
        islands("chrom", "islands", 0).replace("islands AS", "merged AS", 1),
    )
)
def annotation_stats(spark: SparkSession, d: str) -> DataFrame:
    return intervals.annotation_stats(merge_exons(spark, d), ["chrom"])


@query(sql("SELECT locus, chrom, GREATEST(iv_start, 1500) AS iv_start, LEAST(iv_end, 3000) AS iv_end FROM islands WHERE chrom = 3 AND iv_start < 3000 AND iv_end > 1500", islands(LOCUS)))
def subregion(spark: SparkSession, d: str) -> DataFrame:
    return intervals.subregion(merge_exons(spark, d), 3, 1500, 3000).select("locus", "chrom", F.col("iv_start").cast("long").alias("iv_start"), F.col("iv_end").cast("long").alias("iv_end"))


def overlap_sql(strand: bool) -> str:
    key = " AND b.strand = i.strand" if strand else ""
    by = "b.rid, b.ln, b.chrom" + (", b.strand" if strand else "")
    return f"""ovl AS (SELECT {by}, i.locus, CAST(SUM(LEAST(i.iv_end, b.b_end + 1) - GREATEST(i.iv_start, b.b_start)) AS BIGINT) overlap
  FROM st_blocks b JOIN islands i ON b.chrom = i.chrom{key} AND b.b_start < i.iv_end AND i.iv_start < b.b_end + 1 GROUP BY {by}, i.locus)"""


ALIGNMENT = ["rid", "ln", "chrom"]


@query(sql("SELECT * FROM ovl", islands(LOCUS), overlap_sql(False)))
def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.block_overlaps(st.blocks(spark, d), merge_exons(spark, d), ALIGNMENT, ["chrom"])


@query(sql("SELECT * FROM ovl", islands(STRANDED), overlap_sql(True)))
def block_overlap_stranded(spark: SparkSession, d: str) -> DataFrame:
    return intervals.block_overlaps(st.blocks(spark, d), merge_exons_stranded(spark, d), [*ALIGNMENT, "strand"], ["chrom", "strand"])


@query(sql("SELECT * FROM ovl", islands(LOCUS), overlap_sql(False).replace("b.b_end + 1", "b.b_end")))
def step_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.block_overlaps(st.blocks(spark, d), merge_exons(spark, d), ALIGNMENT, ["chrom"], 0)


def stabbed(column: str) -> str:
    return f"(SELECT MIN((i.locus, i.iv_start, i.iv_end)) FROM islands i WHERE i.chrom = b.chrom AND {column} >= i.iv_start AND {column} < i.iv_end)"


@query(sql(f"SELECT rid, ln, chrom, b_start AS pos, {stabbed('b.b_start')}[1] AS locus FROM st_blocks b", islands(LOCUS)))
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    points = st.blocks(spark, d).select(*ALIGNMENT, F.col("b_start").alias("pos"))
    return intervals.point_lookup(points, merge_exons(spark, d), ["chrom"]).select(*ALIGNMENT, "pos", "locus")


@query(
    sql(
        """SELECT rid, ln, chrom, b_start, b_end, CASE WHEN r[1] IS NOT NULL AND (l[1] IS NULL OR (l[1] <> r[1] AND b_end - r[2] > l[3] - b_start)) THEN r[1] ELSE l[1] END AS locus
  FROM (SELECT rid, ln, chrom, b_start, b_end, """
        + f"{stabbed('b.b_start')} l, {stabbed('b.b_end - 1')} r FROM st_blocks b WHERE b_end > b_start)",
        islands(LOCUS),
    )
)
def two_end_lookup(spark: SparkSession, d: str) -> DataFrame:
    spans = st.blocks(spark, d).where("b_end > b_start").select(*ALIGNMENT, "b_start", "b_end")
    return intervals.two_end_lookup(spans, merge_exons(spark, d), ["chrom"]).select(*ALIGNMENT, "b_start", "b_end", "locus")


MERGED_BLOCKS = [
    "block_rows AS (SELECT rid, ln, chrom, b_start iv_start, b_end iv_end FROM st_blocks)",
    islands("rid, ln, chrom", "block_rows").replace("islands AS", "mb AS", 1),
    "aligned AS (SELECT rid, ln, chrom, COUNT(*) n_blocks, CAST(SUM(iv_end - iv_start) AS BIGINT) alnlen FROM mb GROUP BY rid, ln, chrom)",
]


def aligned(spark: SparkSession, d: str) -> DataFrame:
    per = st.blocks(spark, d).groupBy(*ALIGNMENT).agg(F.collect_list(F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end"))).alias("b"))
    merged = per.withColumn("b", intervals.merged_array(F.col("b")))
    return merged.select(*ALIGNMENT, F.size("b").cast("long").alias("n_blocks"), intervals.total_length(F.col("b")).alias("alnlen"))


@query(sql("SELECT rid, ln, chrom, n_blocks, alnlen FROM aligned", *MERGED_BLOCKS))
def merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d)


@query(
    sql(
        """SELECT a.rid, a.ln, a.chrom, CASE WHEN b.overlap > a.alnlen * 0.2 THEN b.locus ELSE '__no_feature' END AS locus, CASE WHEN b.overlap > a.alnlen * 0.2 THEN b.overlap ELSE 0 END AS overlap
  FROM aligned a LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY rid, ln, chrom ORDER BY overlap DESC, locus) rn FROM ovl) b ON a.rid = b.rid AND a.ln = b.ln AND a.chrom = b.chrom AND b.rn = 1""",
        islands(LOCUS),
        overlap_sql(False),
        *MERGED_BLOCKS,
    )
)
def assign_locus(spark: SparkSession, d: str) -> DataFrame:
    return intervals.assign_locus(block_overlap(spark, d), aligned(spark, d), ALIGNMENT)


@query(sql("SELECT chrom AS ref, GREATEST(0, i - 50) AS w_start, LEAST(i + 550, len) AS w_end FROM (SELECT chrom, len, UNNEST(RANGE(0, len, 500)) i FROM (SELECT chrom, MAX(iv_end) len FROM st_exons GROUP BY chrom))"))
def windows_overlap(spark: SparkSession, d: str) -> DataFrame:
    refs = st.exons(spark, d).groupBy(F.col("chrom").alias("ref")).agg(F.max("iv_end").alias("length"))
    return intervals.windows(refs, 500, 50)


# Fragments


@query(sql("SELECT rid, fid, ln, sc, len, CASE WHEN ROW_NUMBER() OVER (PARTITION BY rid, fid ORDER BY sc + len DESC, ln, sc DESC) = 1 THEN 'PRI' ELSE 'SEC' END AS tag FROM st_aln"))
def best_alignment(spark: SparkSession, d: str) -> DataFrame:
    return fragments.best_alignments(st.alignments(spark, d)).select("rid", "fid", "ln", "sc", "len", "tag")


@query(sql("SELECT rid, STRING_AGG(CAST(fid AS VARCHAR), ',' ORDER BY fid DESC) AS zb FROM (SELECT DISTINCT rid, fid FROM (SELECT *, MAX(sc) OVER (PARTITION BY rid) m FROM st_aln) WHERE sc = m) GROUP BY rid"))
def top_features(spark: SparkSession, d: str) -> DataFrame:
    return fragments.top_features(st.alignments(spark, d))


@query(
    sql(
        """SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN NOT mapped THEN 'unmapped' WHEN cb IS NULL THEN 'missing CB' WHEN NOT listed THEN 'CB not listed' WHEN ub IS NULL THEN 'missing UB' WHEN NOT hit THEN 'no overlap' ELSE 'ok' END status
  FROM (SELECT r.rid % 13 <> 0 mapped, CASE WHEN r.rid % 17 <> 0 THEN r.bc END cb, c.c_nationkey < 20 listed, CASE WHEN r.rid % 19 <> 0 THEN r.umi END ub, r.rid IN (SELECT rid FROM st_scores) hit FROM st_reads r JOIN customer c ON r.bc = c.c_custkey)) GROUP BY status"""
    )
)
def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    customers = st.table(spark, d, "customer").select(F.col("c_custkey").alias("bc"), (F.col("c_nationkey") < 20).alias("listed"))
    hits = st.scores(spark, d).select("rid").distinct().withColumn("hit", F.lit(True))
    r = st.reads(spark, d).join(customers, "bc").join(hits, "rid", "left")
    status = fragments.filter_status(F.col("rid") % 13 != 0, F.when(F.col("rid") % 17 != 0, F.col("bc")), F.col("listed"), F.when(F.col("rid") % 19 != 0, F.col("umi")), F.coalesce("hit", F.lit(False)))
    return r.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


MATES = """mates AS (SELECT l_orderkey o, l_partkey % 2 = 1 AS first, l_linenumber ln, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) nth FROM lineitem)"""


@query(sql("SELECT COALESCE(a.o, b.o) AS qname, CASE WHEN a.o IS NULL THEN b.ln ELSE a.ln END AS ln1, CASE WHEN a.o IS NOT NULL THEN b.ln END AS ln2 FROM (SELECT * FROM mates WHERE first) a FULL JOIN (SELECT * FROM mates WHERE NOT first) b ON a.o = b.o AND a.nth = b.nth", MATES))
def mate_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey", F.col("l_partkey") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = li.select(
        F.col("l_orderkey").alias("qname"),
        F.when(F.col("l_partkey") % 2 == 1, fragments.READ1).otherwise(fragments.READ2).alias("flag"),
        *[F.lit("r").alias(c) for c in ("ref", "rnext")],
        *[F.lit(0).alias(c) for c in ("pos", "pnext", "tlen")],
        F.col("l_linenumber").alias("ln"),
        F.row_number().over(order).alias("file_seq"),
    )
    return fragments.pair_mates(rows).select("qname", F.col("r1.ln").alias("ln1"), F.col("r2.ln").alias("ln2"))


@query(sql("SELECT o_orderkey AS qname, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN u1 THEN 'SU' ELSE 'SM' END WHEN proper THEN 'PM' WHEN n = 2 AND nu = 2 THEN 'PU' ELSE 'PX' END AS code FROM (SELECT o.o_orderkey, o.o_custkey, o.o_custkey % 3 = 1 AND MIN_BY(l_quantity, (l_linenumber, l_partkey, l_suppkey)) > 10 AS proper, MIN_BY(l_quantity, (l_linenumber, l_partkey, l_suppkey)) < 25 AS u1, COUNT(*) n, SUM(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) nu FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o.o_orderkey, o.o_custkey)"))
def fragment_codes(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem").join(st.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    paired, proper, un = F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 3 == 1) & (F.col("l_quantity") > 10), F.col("l_quantity") < 25
    flag = F.when(paired, fragments.PAIRED).otherwise(0) + F.when(proper, fragments.PROPER).otherwise(0) + F.when(un, fragments.UNMAPPED).otherwise(0)
    rows = li.select(F.col("l_orderkey").alias("qname"), flag.alias("flag"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("file_seq"))
    return fragments.fragment_codes(rows).select("qname", "code")


@query(sql("SELECT l_orderkey AS rid, l_linenumber AS ln, o_custkey AS bc FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 5 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 1 AND 5)"))
def barcode_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem").join(st.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(F.col("l_orderkey").alias("qname"), F.when(F.col("l_quantity") < 5, fragments.UNMAPPED).otherwise(0).alias("flag"), F.create_map(F.lit("CB"), F.col("o_custkey")).alias("tags"), F.col("l_linenumber").alias("file_seq"))
    cells = st.table(spark, d, "customer").where("c_nationkey BETWEEN 1 AND 5").select(F.col("c_custkey").alias("bc"))
    return fragments.cell_sort(rows, cells).select(F.col("qname").alias("rid"), F.col("file_seq").alias("ln"), "bc")


# Molecules


@query(sql("SELECT bin, COUNT(*) AS umis FROM (SELECT CASE WHEN m <= 5 THEN CASE WHEN n < m THEN CAST(n AS VARCHAR) ELSE '>' || (m - 1) END WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN m <= 20 THEN '>10' WHEN n <= 20 THEN '11-20' ELSE '>20' END bin FROM (SELECT COUNT(*) n, MAX(COUNT(*)) OVER () m FROM st_reads GROUP BY bc, umi)) GROUP BY bin"))
def umi_histogram(spark: SparkSession, d: str) -> DataFrame:
    return umi.histogram(umi.reads_per_umi(st.reads(spark, d)))


@query(sql('SELECT COUNT(*) AS num_umi, COUNT(*) FILTER (n = 1) AS "unique", COUNT(*) FILTER (n > 1) AS duplicated, MAX(n) AS max_reads, CAST(SUM(n - 1) AS BIGINT) AS possible_duplicates FROM (SELECT COUNT(*) n FROM st_reads GROUP BY bc, umi)'))
def umi_summary(spark: SparkSession, d: str) -> DataFrame:
    return umi.summary(umi.reads_per_umi(st.reads(spark, d)))


CELLS = "mcells AS (SELECT bc, umi, rid, fid, raw FROM st_scores JOIN st_reads USING (rid))"
EDGES = "medges AS (SELECT a.bc, a.umi, a.rid r1, b.rid r2, COUNT(*) shared FROM mcells a JOIN mcells b ON a.bc = b.bc AND a.umi = b.umi AND a.fid = b.fid AND a.rid < b.rid WHERE a.fid > 0 GROUP BY a.bc, a.umi, a.rid, b.rid)"
COMPS = [
    CELLS,
    EDGES,
    "both_ways AS (SELECT r1 x, r2 y FROM medges UNION ALL SELECT r2, r1 FROM medges)",
    "reach AS (SELECT DISTINCT rid x, rid y FROM mcells UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)",
    "comps AS (SELECT m.bc, m.umi, m.rid, r.comp FROM (SELECT DISTINCT bc, umi, rid FROM mcells) m JOIN (SELECT x, MIN(y) comp FROM reach GROUP BY x) r ON m.rid = r.x)",
]
REPS = [
    *COMPS,
    "stats AS (SELECT rid, MAX(raw) top, SUM(raw) al, COUNT(*) features FROM st_scores WHERE fid > 0 GROUP BY rid)",
    "reps AS (SELECT bc, umi, comp, rid, size FROM (SELECT *, COUNT(*) OVER (PARTITION BY bc, umi, comp) size, ROW_NUMBER() OVER (PARTITION BY bc, umi, comp ORDER BY CAST(top AS DOUBLE) / CAST(al AS DOUBLE) DESC, features, top DESC, al DESC, rid DESC) rn FROM comps JOIN stats USING (rid)) WHERE rn = 1)",
]


@query(sql("SELECT bc, umi, r1, r2, shared FROM medges", CELLS, EDGES))
def umi_edges(spark: SparkSession, d: str) -> DataFrame:
    return umi.edges(st.reads(spark, d), st.scores(spark, d))


@query(sql("SELECT bc, umi, rid, comp FROM comps", *COMPS))
def umi_components(spark: SparkSession, d: str) -> DataFrame:
    return umi.components(st.reads(spark, d), st.scores(spark, d))


@query(sql("SELECT components, COUNT(*) AS umis FROM (SELECT COUNT(*) reads, COUNT(DISTINCT comp) components FROM comps GROUP BY bc, umi) WHERE reads > 1 GROUP BY components", *COMPS))
def umi_component_summary(spark: SparkSession, d: str) -> DataFrame:
    return umi.component_summary(umi_components(spark, d))


@query(sql("SELECT bc, umi, comp, rid, size FROM reps", *REPS))
def umi_representatives(spark: SparkSession, d: str) -> DataFrame:
    return umi.representatives(umi_components(spark, d), st.scores(spark, d))


@query(sql("SELECT rid, fid, raw FROM st_scores WHERE rid IN (SELECT rid FROM reps)", *REPS))
def umi_corrected(spark: SparkSession, d: str) -> DataFrame:
    return umi.corrected(st.scores(spark, d), umi_representatives(spark, d))


# The mixture model


def em_sql(steps: int, pool: str = "'all'", theta_prior: float = 200000.0, pi_prior: float = 0.0) -> list[str]:
    """CTEs of `steps` iterations: em_q, em_p{i} (pool, fid, pi, theta) and em_z{i} from the parameters before step i."""
    out = [
        f"em_s AS (SELECT {pool} pool, s.rid, s.fid, s.raw FROM st_scores s{' JOIN st_reads USING (rid)' if pool != chr(39) + 'all' + chr(39) else ''})",
        "em_q AS (SELECT *, EXP(100.0::DOUBLE * raw / MAX(raw) OVER (PARTITION BY pool)) - 1 q, CASE WHEN COUNT(*) OVER (PARTITION BY pool, rid) > 1 THEN 1 ELSE 0 END y FROM em_s)",
        "em_w AS (SELECT *, MAX(q) OVER (PARTITION BY pool, rid) w FROM em_q)",
        f"em_t AS (SELECT pool, SUM(w) al, SUM(w * y) am, {pi_prior} * MAX(w) pp, {theta_prior} * MAX(w) tp FROM (SELECT DISTINCT pool, rid, w, y FROM em_w) GROUP BY pool)",
        f"em_u AS (SELECT t.pool, f.fid, COALESCE(SUM(w.q * (1 - w.y)), 0) u FROM em_t t CROSS JOIN (SELECT UNNEST(RANGE({st.K})) fid) f LEFT JOIN em_w w ON w.pool = t.pool AND w.fid = f.fid GROUP BY t.pool, f.fid)",
        f"em_p0 AS (SELECT pool, fid, 1.0::DOUBLE / {st.K} pi, 1.0::DOUBLE / {st.K} theta FROM em_u)",
    ]
    for i in range(1, steps + 1):
        out.append(f"em_z{i} AS MATERIALIZED (SELECT pool, rid, fid, raw, w, y, v / SUM(v) OVER (PARTITION BY pool, rid) z FROM (SELECT e.*, e.q * p.pi * CASE WHEN e.y = 1 THEN p.theta ELSE 1 END v FROM em_w e JOIN em_p{i - 1} p ON p.pool = e.pool AND p.fid = e.fid))")
        out.append(f"em_p{i} AS MATERIALIZED (SELECT u.pool, u.fid, (u.u + COALESCE(z.t, 0) + m.pp) / (m.al + m.pp * {st.K}) pi, (COALESCE(z.t, 0) + m.tp) / (m.am + m.tp * {st.K}) theta FROM em_u u JOIN em_t m ON m.pool = u.pool LEFT JOIN (SELECT pool, fid, SUM(z * w * y) t FROM em_z{i} GROUP BY pool, fid) z ON z.pool = u.pool AND z.fid = u.fid)")
    return out


def pooled(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    s = st.scores(spark, d)
    if by is None:
        return s.withColumn("pool", F.lit("all"))
    return s.join(st.reads(spark, d).select("rid", F.col(by).cast("string").alias("pool")), "rid")


def params(spark: SparkSession, d: str, steps: int, by: str | None = None, **options: float) -> DataFrame:
    return em.fit(pooled(spark, d, by), em.Options(st.K, max_iter=steps, **options))


for _name, _steps, _by in (("em_step1", 1, None), ("em_step3", 3, None), ("em_celltype_step2", 2, "celltype"), ("em_individual", 2, "bc")):
    query(sql(f"SELECT pool, fid, ROUND(pi, 9) AS pi, ROUND(theta, 9) AS theta FROM em_p{_steps}", *em_sql(_steps, {None: "'all'", "bc": "CAST(bc AS VARCHAR)"}.get(_by, _by))), _name)(lambda spark, d, n=_steps, by=_by: rounded(rounded(params(spark, d, n, by), "pi"), "theta").select("pool", "fid", "pi", "theta"))

LOGLIK = "em_l AS (SELECT SUM(z.z * (LN(e.q) + LN(p.pi) + CASE WHEN e.y = 1 THEN LN(p.theta) ELSE 0 END)) lnl, COUNT(DISTINCT e.rid) obs, 2 * COUNT(DISTINCT e.fid) params FROM em_z2 z JOIN em_w e ON e.rid = z.rid AND e.fid = z.fid JOIN em_p2 p ON p.fid = e.fid WHERE z.z > 0)"


@query(sql("SELECT ROUND(lnl, 3) AS lnl FROM em_l", *em_sql(2), LOGLIK))
def em_loglik(spark: SparkSession, d: str) -> DataFrame:
    return params(spark, d, 2).select(F.round("lnl", 3).alias("lnl")).limit(1)


@query(sql("SELECT ROUND(lnl, 3) AS lnl, obs, CAST(params AS BIGINT) AS params, ROUND(2 * params - 2 * lnl, 3) AS aic, ROUND(params * LN(obs) - 2 * lnl, 3) AS bic FROM em_l", *em_sql(2), LOGLIK))
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    got = em.model_selection(pooled(spark, d), params(spark, d, 2))
    return got.select(F.round("lnl", 3).alias("lnl"), "obs", "params", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"))


def fitted(spark: SparkSession, d: str, steps: int = 2) -> DataFrame:
    cells = pooled(spark, d)
    return em.posteriors(cells, params(spark, d, steps))


@query(sql("SELECT rid, fid, ROUND(z, 9) AS z FROM em_z2", *em_sql(2)))
def em_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fitted(spark, d), "z").select("rid", "fid", "z")


# Reassignment

BEST = "zb AS (SELECT *, COUNT(*) OVER (PARTITION BY rid) nbest FROM (SELECT *, MAX(ROUND(z, 10)) OVER (PARTITION BY rid) m FROM em_z2) WHERE ROUND(z, 10) = m AND z > 0)"
RAW_BEST = "rb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rid ORDER BY fid) rn, COUNT(*) OVER (PARTITION BY rid) nbest FROM (SELECT *, MAX(raw) OVER (PARTITION BY rid) m FROM st_scores) WHERE raw = m)"
ONE = "1.0::DOUBLE AS w"

for _mode, _sql in (
    ("initial_unique", sql(f"SELECT rid, fid, {ONE} FROM (SELECT *, COUNT(*) OVER (PARTITION BY rid) n FROM st_scores) WHERE n = 1")),
    ("total_hits", sql(f"SELECT rid, fid, {ONE} FROM st_scores")),
    ("best_exclude", sql(f"SELECT rid, fid, {ONE} FROM zb WHERE nbest = 1", *em_sql(2), BEST)),
    ("best_average", sql("SELECT rid, fid, ROUND(1.0::DOUBLE / nbest, 9) AS w FROM zb", *em_sql(2), BEST)),
    ("best_conf", sql(f"SELECT rid, fid, {ONE} FROM em_z2 WHERE z > 0.9", *em_sql(2))),
):

    def _reassigned(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        cells = fitted(spark, d) if mode.startswith("best") else st.scores(spark, d)
        return rounded(reassign.reassign(cells, mode), "w")

    query(_sql, f"reassign_{_mode}")(_reassigned)


@query(sql(f"SELECT rid, fid, {ONE} FROM rb WHERE rn = 1", RAW_BEST))
def reassign_initial_best(spark: SparkSession, d: str) -> DataFrame:
    return reassign.initial_best(st.scores(spark, d))


NB = "COUNT(*) FILTER (nbest = 1) AS assigned, COUNT(*) FILTER (nbest > 1) AS ambiguous, (SELECT COUNT(DISTINCT rid) FROM st_scores) - COUNT(*) AS unaligned"


@query(
    sql(
        f"""SELECT 'best_exclude' AS mode, {NB} FROM (SELECT DISTINCT rid, nbest FROM zb)
  UNION ALL SELECT 'initial_random', {NB} FROM (SELECT DISTINCT rid, nbest FROM rb)
  UNION ALL SELECT 'best_conf', COUNT(*) FILTER (m > 0.9), COUNT(*) FILTER (m <= 0.9), (SELECT COUNT(DISTINCT rid) FROM st_scores) - COUNT(*) FROM (SELECT rid, MAX(z) m FROM em_z2 GROUP BY rid)
  UNION ALL SELECT 'initial_unique', COUNT(*) FILTER (n = 1), COUNT(*) FILTER (n > 1), 0 FROM (SELECT COUNT(*) n FROM st_scores GROUP BY rid)
  UNION ALL SELECT 'total_hits', CAST(SUM(n) AS BIGINT), COUNT(*) FILTER (n > 1), 0 FROM (SELECT COUNT(*) n FROM st_scores GROUP BY rid)""",
        *em_sql(2),
        BEST,
        RAW_BEST,
    )
)
def reassign_summary(spark: SparkSession, d: str) -> DataFrame:
    z = fitted(spark, d)
    out = None
    for mode in ("best_exclude", "initial_random", "best_conf", "initial_unique", "total_hits"):
        one = reassign.summary(z if mode.startswith("best") else st.scores(spark, d), mode)
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT bc, fid, CAST(COUNT(*) AS DOUBLE) AS n FROM st_scores JOIN st_reads USING (rid) GROUP BY bc, fid"))
def counts_bc(spark: SparkSession, d: str) -> DataFrame:
    return reassign.counts_by_cell(reassign.reassign(st.scores(spark, d), "total_hits"), st.reads(spark, d))


@query(sql("SELECT bc, fid, COUNT(DISTINCT umi) AS n FROM st_scores JOIN st_reads USING (rid) GROUP BY bc, fid"))
def counts_umi(spark: SparkSession, d: str) -> DataFrame:
    return reassign.umi_counts_by_cell(reassign.reassign(st.scores(spark, d), "total_hits"), st.reads(spark, d))


@query(sql("SELECT c_custkey AS bc, fid, COALESCE(n, 0.0) AS n FROM customer LEFT JOIN (SELECT bc, fid, CAST(COUNT(*) AS DOUBLE) n FROM st_scores JOIN st_reads USING (rid) GROUP BY bc, fid) ON bc = c_custkey"))
def counts_complete(spark: SparkSession, d: str) -> DataFrame:
    return reassign.complete_cells(counts_bc(spark, d), st.table(spark, d, "customer").select(F.col("c_custkey").alias("bc"))).withColumn("n", F.col("n").cast("double"))


@query(sql("SELECT bc, fid, n FROM (SELECT *, MAX(CASE WHEN fid < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY bc) lo, MAX(CASE WHEN fid >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY bc) hi FROM (SELECT bc, fid, CAST(COUNT(*) AS DOUBLE) n FROM st_scores JOIN st_reads USING (rid) GROUP BY bc, fid)) WHERE lo = 1 AND hi = 1"))
def merge_matrices(spark: SparkSession, d: str) -> DataFrame:
    c = counts_bc(spark, d)
    return reassign.merge_counts(c.where("fid < 20"), c.where("fid >= 20").withColumn("fid", F.col("fid") - 20), 20)


@query(sql("SELECT rid, fid, CASE WHEN z >= 1 THEN 255 ELSE CAST(ROUND_EVEN(-10 * LOG10(1 - z), 0) AS INT) END AS mapq FROM (SELECT rid, fid, ROUND(z, 9) z FROM em_z2)", *em_sql(2)))
def phred_mapq(spark: SparkSession, d: str) -> DataFrame:
    return em_posteriors(spark, d).select("rid", "fid", scalars.phred(F.col("z")).alias("mapq"))


@query(sql("SELECT mode AS \"mode\", colour, COUNT(*) AS n FROM (SELECT 'best_exclude' AS mode, CASE WHEN t.rn > 1 THEN '248,248,248' WHEN b.rid IS NOT NULL THEN '213,94,0' WHEN ROUND(COALESCE(z.z, 0), 9) >= 0.2 THEN '240,228,66' ELSE '210,240,215' END colour FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rid, fid ORDER BY sc + len DESC, ln, sc DESC) rn FROM st_aln) t LEFT JOIN em_z2 z ON z.rid = t.rid AND z.fid = t.fid LEFT JOIN (SELECT rid, fid FROM zb WHERE nbest = 1) b ON b.rid = t.rid AND b.fid = t.fid) GROUP BY mode, colour", *em_sql(2), BEST))
def updated_alignments(spark: SparkSession, d: str) -> DataFrame:
    z = fitted(spark, d)
    rows = fragments.best_alignments(st.alignments(spark, d)).withColumn("flag", F.lit(0))
    out = fragments.updated(rows, rounded(z, "z"), reassign.reassign(z, "best_exclude"))
    return out.groupBy(F.lit("best_exclude").alias("mode"), "colour").agg(F.count(F.lit(1)).alias("n"))


# Text and numbers


@query(sql("SELECT p_partkey AS id, p_name AS gene_id, p_brand AS locus, CAST(p_size AS VARCHAR) AS pos FROM part"))
def attributes_map(spark: SparkSession, d: str) -> DataFrame:
    p = st.table(spark, d, "part")
    text = F.concat(F.lit('gene_id "x"; gene_id "'), "p_name", F.lit('"; locus "'), "p_brand", F.lit('"; pos "'), F.col("p_size").cast("string"), F.lit('";'))
    m = p.select(F.col("p_partkey").alias("id"), scalars.attributes(text).alias("m"))
    return m.select("id", *[F.col("m")[k].alias(k) for k in ("gene_id", "locus", "pos")])


@query(sql("SELECT conv_id, turn, LAST_VALUE(CASE WHEN turn = 0 THEN role || ':' || LENGTH(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM conversations"))
def ffill_headers(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("turn") == 0, F.concat("role", F.lit(":"), F.length("text").cast("string")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return st.table(spark, d, "conversations").select("conv_id", "turn", F.last(head, ignorenulls=True).over(w).alias("head"))


@query(sql("SELECT o_orderkey AS id, CASE WHEN x >= 1000000 THEN PRINTF('%.1fM', x / 1000000) WHEN x >= 1000 THEN PRINTF('%.1fK', x / 1000) ELSE PRINTF('%.1f', x) END AS txt FROM (SELECT o_orderkey, CAST(FLOOR(o_totalprice / 100) * 100 AS DOUBLE) x FROM orders)"))
def human_format(spark: SparkSession, d: str) -> DataFrame:
    return st.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.human_format(F.floor(F.col("o_totalprice") / 100) * 100).alias("txt"))


@query(sql("SELECT event_id AS id, PRINTF('%d minutes and %d secs', s // 60, s % 60) AS minutes, PRINTF('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS delta FROM (SELECT event_id, CAST(FLOOR(EPOCH(ts)) AS BIGINT) % 100000 s FROM events)"))
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_timestamp(F.col("ts").cast("timestamp")) % 100000
    return st.table(spark, d, "events").select(F.col("event_id").alias("id"), scalars.format_minutes(s).alias("minutes"), scalars.format_delta(s).alias("delta"))


@query(sql("SELECT l_orderkey AS rid, l_linenumber AS ln, ROUND(1 - POWER(10, -q / 10), 9) AS p FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) q FROM lineitem)"))
def inverse_phred(spark: SparkSession, d: str) -> DataFrame:
    return st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("ln"), F.round(scalars.eprob(F.col("l_quantity")), 9).alias("p"))


@query(sql("SELECT chunk, CAST(COUNT(*) AS BIGINT) AS n, MIN(bc) AS first_bc, MAX(bc) AS last_bc FROM (SELECT c_custkey bc, (ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) // 7 chunk FROM customer) GROUP BY chunk"))
def chunks(spark: SparkSession, d: str) -> DataFrame:
    from locusmill.operators.index import dense_index

    c = dense_index(st.table(spark, d, "customer").select(F.col("c_custkey").alias("bc")), ["bc"])
    return c.groupBy(F.floor(F.col("idx") / 7).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("bc").alias("first_bc"), F.max("bc").alias("last_bc"))


@query(sql("SELECT locus, ROW_NUMBER() OVER (ORDER BY locus) AS fid FROM (SELECT DISTINCT locus FROM st_exons) UNION ALL SELECT '__no_feature', 0"))
def feature_index(spark: SparkSession, d: str) -> DataFrame:
    from locusmill.operators.index import features

    return features(st.exons(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to a pseudobulk fit, best_exclude reassignment, and counts per cell and feature."""
    z = fitted(spark, sf_dir, 3)
    counts = reassign.counts_by_cell(reassign.reassign(z, "best_exclude"), st.reads(spark, sf_dir))
    return counts.orderBy("bc", "fid")


@query(sql("SELECT bc, fid, CAST(COUNT(*) AS DOUBLE) AS n FROM zb JOIN st_reads USING (rid) WHERE nbest = 1 GROUP BY bc, fid", *em_sql(3), BEST.replace("em_z2", "em_z3")))
def assign_counts(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)
