"""More queries on the stand-in tables: mates, regions, tags, summaries, random picks and fixed points, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import scalars
from locusmill.operators import em, fragments, intervals, matrix, reassign, segments, umi
from locusmill.plans import standins as st
from locusmill.plans.catalogue import COMPS, pooled, query, umi_components
from locusmill.plans.standins import sql

# Mates and regions: an order's lines stand for alignments, its supplier and part for a mate's place.

PLACES = "places AS (SELECT l_orderkey rid, l_linenumber ln, l_partkey % 7 r, l_partkey % 50 p, l_suppkey % 7 mr, l_suppkey % 50 mp FROM lineitem)"


def places(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("ln"), *[(F.col(c) % m).alias(n) for c, m, n in (("l_partkey", 7, "r"), ("l_partkey", 50, "p"), ("l_suppkey", 7, "mr"), ("l_suppkey", 50, "mp"))])


@query(sql("SELECT rid, ln, r, p, mr, mp, CASE WHEN mr = r THEN mp < p ELSE mr < r END AS before, CASE WHEN mr = r THEN mp > p ELSE mr > r END AS after, mr = r AND mp = p AS same, mr = 3 AND mp > 10 AND mp < 30 AS inside FROM places", PLACES))
def mate_position(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("r", "p", "mr", "mp")]
    return places(spark, d).select("*", segments.mate_before(*c).alias("before"), segments.mate_after(*c).alias("after"), segments.mate_same(*c).alias("same"), segments.mate_in_region(c[2], c[3], 3, 10, 30).alias("inside"))


def as_alignments(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem")
    flag = F.when(F.col("l_quantity") < 5, fragments.UNMAPPED).otherwise(0)
    return li.select(F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("file_seq"), flag.alias("flag"), (F.col("l_suppkey") % 5).alias("ref"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("int").alias("span"))


@query(sql("SELECT l_orderkey AS qname, l_linenumber AS ln FROM lineitem WHERE l_suppkey % 5 = 2 AND l_quantity >= 5 AND l_partkey - 1 < 120 AND l_partkey - 1 + CAST(l_quantity AS INT) > 40"))
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    return segments.region_scan(as_alignments(spark, d), 2, 40, 120, F.col("span")).select("qname", F.col("file_seq").alias("ln"))


@query(sql("SELECT l_suppkey % 5 AS ref, COUNT(*) FILTER (l_quantity >= 5) AS mapped, COUNT(*) FILTER (l_quantity < 5) AS unmapped FROM lineitem GROUP BY l_suppkey % 5"))
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    per = as_alignments(spark, d).groupBy("ref")
    return per.agg(F.count_if(~fragments.flag(fragments.UNMAPPED)).alias("mapped"), F.count_if(fragments.flag(fragments.UNMAPPED)).alias("unmapped"))


@query(sql("SELECT a.rid, a.ln, CASE WHEN GREATEST(a.p, a.mp) - LEAST(a.p + 4, a.mp + 6) <= 2 THEN LEAST(a.p, a.mp) END AS h_start, CASE WHEN GREATEST(a.p, a.mp) - LEAST(a.p + 4, a.mp + 6) <= 2 THEN GREATEST(a.p + 4, a.mp + 6) END AS h_end, GREATEST(0, LEAST(a.p + 4, a.mp + 6) - GREATEST(a.p, a.mp)) AS overlap FROM places a", PLACES))
def interval_hull(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p"), F.col("mp")
    h = intervals.hull(a, a + 4, b, b + 6, 2)
    return places(spark, d).select("rid", "ln", h["start"].alias("h_start"), h["end"].alias("h_end"), intervals.overlap_length(a, a + 4, b, b + 6).alias("overlap"))


# Pairs: flags, tags and facts.

TWO = "two AS (SELECT o_orderkey q, o_custkey % 64 f1, o_custkey % 3 = 0 has2, (o_custkey + 7) % 64 f2, o_orderpriority t1, o_orderstatus t2 FROM orders)"


def two_reads(spark: SparkSession, d: str) -> DataFrame:
    o = st.table(spark, d, "orders")
    tags = "map<string,string>"
    one = F.struct(F.col("o_orderkey").alias("qname"), (F.col("o_custkey") % 64).cast("int").alias("flag"), F.lit("r").alias("ref"), F.lit(7).alias("mapq"), F.create_map(F.lit("CB"), F.col("o_orderpriority")).cast(tags).alias("tags"), F.col("o_orderkey").alias("file_seq"))
    two = F.struct(F.col("o_orderkey").alias("qname"), ((F.col("o_custkey") + 7) % 64).cast("int").alias("flag"), F.lit("r").alias("ref"), F.lit(7).alias("mapq"), F.create_map(F.lit("CB"), F.col("o_orderstatus")).cast(tags).alias("tags"), F.col("o_orderkey").alias("file_seq"))
    return o.select(F.col("o_orderkey").alias("qname"), one.alias("r1"), F.when(F.col("o_custkey") % 3 == 0, two).alias("r2"))


@query(sql("SELECT q AS qname, f1 | 16 AS f1, CASE WHEN has2 THEN f2 | 16 END AS f2, 30 AS q1, CASE WHEN has2 THEN 30 END AS q2, t1 AS cb, 'x' AS zf FROM two", TWO))
def mark_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = segments.mark_pair(two_reads(spark, d), F.lit(30), fragments.REVERSE, True, ("ZF", F.lit("x")))
    return p.select("qname", F.col("r1.flag").alias("f1"), F.col("r2.flag").alias("f2"), F.col("r1.mapq").alias("q1"), F.col("r2.mapq").alias("q2"), F.col("r1.tags")["CB"].alias("cb"), F.col("r1.tags")["ZF"].alias("zf"))


@query(sql("SELECT q AS qname, f1 & ~5 AS f1, CASE WHEN has2 THEN f2 & ~5 END AS f2 FROM two", TWO))
def unset_flags(spark: SparkSession, d: str) -> DataFrame:
    p = segments.mark_pair(two_reads(spark, d), bit=fragments.PAIRED | fragments.UNMAPPED, on=False)
    return p.select("qname", F.col("r1.flag").alias("f1"), F.col("r2.flag").alias("f2"))


@query(sql("SELECT q AS qname, t1 AS first, t1 AS a, CASE WHEN has2 THEN t2 END AS b FROM two", TWO))
def pair_tags(spark: SparkSession, d: str) -> DataFrame:
    return segments.pair_tags(two_reads(spark, d), "CB").select("qname", "first", F.col("all")[0]["r1"].alias("a"), F.col("all")[0]["r2"].alias("b"))


@query(sql("SELECT q AS qname, CASE WHEN has2 THEN 2 ELSE 1 END AS num_reads, has2 AS is_pair, f1 & 4 <> 0 AS is_unmapped, 'r' AS ref_name FROM two", TWO))
def pair_facts(spark: SparkSession, d: str) -> DataFrame:
    return segments.pair_facts(two_reads(spark, d)).select("qname", "num_reads", "is_pair", "is_unmapped", "ref_name")


@query(sql("SELECT l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '/1' ELSE '/2' END AS qname, l_linenumber AS ln FROM lineitem"))
def suffixed_names(spark: SparkSession, d: str) -> DataFrame:
    rows = st.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_linenumber") % 2 == 0, fragments.READ1).otherwise(fragments.READ2).alias("flag"))
    return segments.suffixed_names(rows).select("qname", "ln")


@query(sql("SELECT rid, fid, MAX(sc) AS sc, MIN(len) FILTER (sc = m) AS nm FROM (SELECT *, MAX(sc) OVER (PARTITION BY rid, fid) m FROM st_aln) GROUP BY rid, fid"))
def best_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return segments.best_by_distance(st.alignments(spark, d).withColumnRenamed("len", "nm"), 3).select("rid", "fid", "sc", "nm")


@query(sql('SELECT rid, MIN(b_start) AS "begin", MAX(b_end) AS "end" FROM st_blocks GROUP BY rid'))
def alignment_span(spark: SparkSession, d: str) -> DataFrame:
    return segments.span(st.blocks(spark, d))


# Summaries

STATUS = """stat AS (SELECT r.rid, CASE WHEN r.rid % 3 = 0 THEN 'SM' ELSE 'PM' END code, CASE WHEN r.rid % 13 = 0 THEN 'unmapped' WHEN r.rid % 17 = 0 THEN 'missing CB' WHEN r.rid % 19 = 0 THEN 'missing UB' WHEN s.rid IS NULL THEN 'no overlap' ELSE 'ok' END status, a.n, a.low, a.high
  FROM st_reads r JOIN (SELECT rid, COUNT(*) n, MIN(sc) low, MAX(sc) high FROM st_aln GROUP BY rid) a ON a.rid = r.rid LEFT JOIN (SELECT DISTINCT rid FROM st_scores WHERE raw > 60) s ON s.rid = r.rid)"""


def statuses(spark: SparkSession, d: str) -> DataFrame:
    per = st.alignments(spark, d).groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("sc").alias("low"), F.max("sc").alias("high"))
    hit = st.scores(spark, d).where("raw > 60").select("rid").distinct().withColumn("hit", F.lit(True))
    r = st.reads(spark, d).join(per, "rid").join(hit, "rid", "left")
    status = fragments.filter_status(F.col("rid") % 13 != 0, F.when(F.col("rid") % 17 != 0, F.col("bc")), F.lit(True), F.when(F.col("rid") % 19 != 0, F.col("umi")), F.coalesce("hit", F.lit(False)))
    return r.select("rid", F.when(F.col("rid") % 3 == 0, "SM").otherwise("PM").alias("code"), status.alias("status"), "n", "low", "high")


@query(
    sql(
        """SELECT COUNT(*) AS total_fragments, COUNT(*) FILTER (code = 'PM') AS paired, COUNT(*) FILTER (code = 'SM') AS single, COUNT(*) FILTER (status = 'unmapped') AS unmapped,
  COUNT(*) FILTER (status = 'ok' AND n = 1) AS loc_unique, COUNT(*) FILTER (status = 'ok' AND n > 1) AS loc_ambig, COUNT(*) FILTER (status = 'no overlap' AND n = 1) AS noloc_unique, COUNT(*) FILTER (status = 'no overlap' AND n > 1) AS noloc_ambig,
  MIN(low) FILTER (status IN ('ok', 'no overlap')) AS "minAS", MAX(high) FILTER (status IN ('ok', 'no overlap')) AS "maxAS" FROM stat""",
        STATUS,
    )
)
def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return fragments.alignment_summary(statuses(spark, d))


@query(sql("SELECT status, COUNT(*) AS n FROM stat WHERE status LIKE 'missing%' GROUP BY status ORDER BY n DESC, status", STATUS))
def fragment_errors(spark: SparkSession, d: str) -> DataFrame:
    return fragments.errors(statuses(spark, d))


@query(sql("SELECT rid AS qname, MIN(ln) AS first_seq, MIN_BY(fid, ln) % 1 AS bc FROM st_aln GROUP BY rid"))
def consistent_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = st.alignments(spark, d).select(F.col("rid").alias("qname"), (F.col("fid") % 1).cast("string").alias("bc"), F.lit("u").alias("umi"), F.col("ln").alias("file_seq"))
    return fragments.consistent_tags(rows).select("qname", "first_seq", F.col("bc").cast("long").alias("bc"))


WHOLE = "several AS (SELECT COUNT(*) reads, COUNT(DISTINCT comp) components FROM comps GROUP BY bc, umi HAVING COUNT(*) > 1)"


@query(
    sql(
        'SELECT COUNT(*) AS num_umi, COUNT(*) FILTER (n = 1) AS "unique", COUNT(*) FILTER (n > 1) AS duplicated, MAX(n) AS max_reads, CAST(SUM(n - 1) AS BIGINT) AS possible_duplicates, (SELECT CAST(COALESCE(SUM(reads - components), 0) AS BIGINT) FROM several) AS excluded, (SELECT COALESCE(MAX(components), 0) FROM several) AS max_components FROM (SELECT COUNT(*) n FROM st_reads GROUP BY bc, umi)',
        *COMPS,
        WHOLE,
    )
)
def umi_whole_summary(spark: SparkSession, d: str) -> DataFrame:
    return umi.whole_summary(umi.reads_per_umi(st.reads(spark, d)), umi_components(spark, d))


@query(sql("SELECT bc, umi FROM comps GROUP BY bc, umi HAVING COUNT(*) = 3 AND COUNT(DISTINCT comp) = 2", *COMPS))
def umi_groups(spark: SparkSession, d: str) -> DataFrame:
    return umi.groups_like(umi_components(spark, d), 3, 2)


@query(sql("SELECT m.bc, m.umi, MIN(m.rid) AS least, COUNT(DISTINCT m.rid) = 1 OR COALESCE(ANY_VALUE(x.n), 0) = COUNT(DISTINCT m.rid) AS shared FROM mcells m LEFT JOIN (SELECT bc, umi, MAX(n) n FROM (SELECT bc, umi, fid, COUNT(DISTINCT rid) n FROM mcells WHERE fid > 0 GROUP BY bc, umi, fid) GROUP BY bc, umi) x ON x.bc = m.bc AND x.umi = m.umi GROUP BY m.bc, m.umi", COMPS[0]))
def umi_common_feature(spark: SparkSession, d: str) -> DataFrame:
    return umi.common_feature(st.scores(spark, d).join(st.reads(spark, d), "rid").select("bc", "umi", "rid", "fid"))


TOP = "top_cells AS (SELECT rid, fid, raw FROM (SELECT *, MAX(raw) OVER (PARTITION BY rid) m FROM st_scores) WHERE raw = m)"


@query(sql("SELECT rid, fid, raw FROM top_cells", TOP))
def top_scores(spark: SparkSession, d: str) -> DataFrame:
    return matrix.top_scores(st.scores(spark, d))


@query(sql("SELECT bc, umi, rid, comp FROM comps", TOP, *[c.replace("FROM st_scores JOIN st_reads", "FROM top_cells JOIN st_reads") for c in COMPS]))
def umi_components_top(spark: SparkSession, d: str) -> DataFrame:
    return umi.components(st.reads(spark, d), st.scores(spark, d), best_score=True)


@query(sql("SELECT r.rid, CASE WHEN s.rid IS NULL THEN 1 ELSE 0 END AS value FROM st_reads r LEFT JOIN (SELECT DISTINCT rid FROM st_scores WHERE raw > 60) s ON s.rid = r.rid"))
def complement(spark: SparkSession, d: str) -> DataFrame:
    vector = st.scores(spark, d).where("raw > 60").select("rid", F.lit(1).alias("value")).distinct()
    return matrix.complement(vector, st.reads(spark, d))


@query(sql("SELECT rid, fid, ROUND(CAST(raw AS DOUBLE) / 37, 9) AS value FROM st_scores"))
def divide_by_logs(spark: SparkSession, d: str) -> DataFrame:
    return st.scores(spark, d).select("rid", "fid", F.round(scalars.divide_by_logs(F.col("raw").cast("double"), F.lit(37.0)), 9).alias("value"))


@query(sql("SELECT rid, LENGTH(CAST(bc AS VARCHAR)) || ':' || bc || LENGTH(umi) || ':' || umi AS key, CAST(bc AS VARCHAR) AS a, umi AS b FROM st_reads"))
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = st.reads(spark, d).select("rid", scalars.key_text(F.col("bc"), F.col("umi")).alias("key"))
    a, b = scalars.key_parts(F.col("key"), 2)
    return keyed.select("rid", "key", a.alias("a"), b.alias("b"))


@query(sql("SELECT DISTINCT celltype FROM st_reads ORDER BY celltype"))
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return st.reads(spark, d).select("celltype").distinct().orderBy("celltype")


@query(sql("SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN '27,158,119' WHEN 1 THEN '217,95,2' END AS colour FROM nation"))
def named_colours(spark: SparkSession, d: str) -> DataFrame:
    key = F.element_at(F.array(F.lit("teal"), F.lit("vermilion"), F.lit("none")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return st.table(spark, d, "nation").select(F.col("n_name").alias("name"), scalars.named_colour(key).alias("colour"))


# Random picks: any of the best cells, one for each row; and the fit's fixed point.


def pick_support(picked: DataFrame, cells: DataFrame, value: str, digits: int | None) -> DataFrame:
    """Per row: how many cells were picked, and whether all of them are among its best."""
    top = reassign.best(cells, value, digits).select("rid", "fid", F.lit(True).alias("top"))
    return picked.join(top, ["rid", "fid"], "left").groupBy("rid").agg(F.count(F.lit(1)).alias("picks"), F.every(F.coalesce("top", F.lit(False))).alias("best"))


@query(sql("SELECT DISTINCT rid, 1 AS picks, true AS best FROM st_scores WHERE raw > 0"))
def reassign_initial_random(spark: SparkSession, d: str) -> DataFrame:
    cells = st.scores(spark, d)
    return pick_support(reassign.reassign(cells, "initial_random", seed=7), cells, "raw", None)


@query(sql("SELECT DISTINCT rid, 1 AS picks, true AS best FROM st_scores"))
def reassign_best_random(spark: SparkSession, d: str) -> DataFrame:
    cells = pooled(spark, d)
    z = em.posteriors(cells, em.fit(cells, em.Options(st.K, max_iter=2)))
    return pick_support(reassign.reassign(z, "best_random", seed=7), z, "z", reassign.TIE_DIGITS)


@query(sql("SELECT rid, COUNT(*) AS cells, 1 AS picks, true AS known FROM st_scores GROUP BY rid"))
def choose_random(spark: SparkSession, d: str) -> DataFrame:
    cells = st.scores(spark, d)
    picked = matrix.choose_random(cells, 7).select("rid", "fid", F.lit(1).alias("won"))
    both = cells.join(picked, ["rid", "fid"], "full_outer")
    return both.groupBy("rid").agg(F.count("raw").alias("cells"), F.count("won").alias("picks"), F.every(F.col("raw").isNotNull()).alias("known"))


def fixed_point(spark: SparkSession, d: str, by: str | None) -> DataFrame:
    """Per pool whether the fit to its end has parameters that one more step leaves as they are, and shares that sum to 1."""
    p = em.fit(pooled(spark, d, by), em.Options(st.K, max_iter=400, theta_prior=0.0))
    return p.groupBy("pool").agg((F.sum(F.abs(F.col("pi") - F.col("pi_before"))) < 1e-6).alias("still"), (F.abs(F.sum("pi") - 1) < 1e-6).alias("whole"))


@query(sql("SELECT 'all' AS pool, true AS still, true AS whole"))
def em_pseudobulk(spark: SparkSession, d: str) -> DataFrame:
    return fixed_point(spark, d, None)


@query(sql("SELECT DISTINCT CAST(celltype AS VARCHAR) AS pool, true AS still, true AS whole FROM st_scores JOIN st_reads USING (rid)"))
def em_fixed_point_celltype(spark: SparkSession, d: str) -> DataFrame:
    return fixed_point(spark, d, "celltype")
