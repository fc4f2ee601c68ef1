"""Operators on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.functions import scalars
from locusmill.operators import em, fragments, intervals, matrix, reassign, umi


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(("distance", "want"), [(1, [(1, 5), (8, 12), (16, 20)]), (3, [(1, 12), (16, 20)]), (4, [(1, 20)])])
def test_merge_distance(spark, distance, want):
    iv = spark.createDataFrame([("a", 1, 5), ("a", 8, 12), ("a", 16, 20)], "k string, iv_start int, iv_end int")
    assert rows(intervals.merge_intervals(iv, ["k"], distance=distance).select("iv_start", "iv_end")) == want
    got = iv.groupBy("k").agg(intervals.merged_array(F.collect_list(F.struct(F.col("iv_start").alias("start"), F.col("iv_end").alias("end"))), distance).alias("m")).first()[1]
    assert [tuple(x) for x in got] == want


def test_matrix_kernels(spark):
    m = spark.createDataFrame([(0, 0, 1), (0, 2, 2), (1, 2, 3), (2, 0, 4), (2, 1, 5), (2, 2, 6)], "rid int, fid int, raw int")
    assert [r[2] for r in rows(matrix.norm(m))] == pytest.approx([v / 21 for v in (1, 2, 3, 4, 5, 6)])
    assert [r[2] for r in rows(matrix.norm(m, 1))] == pytest.approx([1 / 3, 2 / 3, 1, 4 / 15, 5 / 15, 6 / 15])
    b = spark.createDataFrame([(0, 0, 6), (0, 2, 2), (1, 2, 3), (2, 0, 4), (2, 1, 5), (2, 2, 6)], "rid int, fid int, raw int")
    assert rows(matrix.binmax(b)) == [(0, 0, 1), (2, 2, 1)]
    assert rows(matrix.binmax(b, 1)) == [(0, 0, 1), (1, 2, 1), (2, 2, 1)]
    zero = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "rid int, fid int, raw int")
    assert [r[2] for r in rows(matrix.norm(zero, 1))] == [0.0, 0.0]


def test_overlaps(spark):
    loci = spark.createDataFrame([("chr1", 10000, 20001, "l1"), ("chr1", 40000, 50001, "l2"), ("chr2", 40000, 45001, "l5"), ("chr2", 46000, 51001, "l5"), ("chr3", 40000, 51001, "l8")], "chrom string, iv_start long, iv_end long, locus string")
    blocks = spark.createDataFrame([(0, "chr1", 1, 10000), (1, "chr1", 19990, 40000), (2, "chr2", 44990, 46010), (3, "chr3", 44990, 46010), (4, "chr1", 20001, 39999), (5, "chr9", 1, 99)], "id int, chrom string, b_start long, b_end long")
    got = rows(intervals.block_overlaps(blocks, loci, ["id"], ["chrom"]))
    assert got == [(0, "l1", 1), (1, "l1", 11), (1, "l2", 1), (2, "l5", 22), (3, "l8", 1021)]
    cut = intervals.subregion(loci, "chr3", 30000, 50000)
    assert rows(intervals.block_overlaps(blocks.where("id = 3").withColumn("b_start", F.lit(40000)).withColumn("b_end", F.lit(45000)), cut, ["id"], ["chrom"])) == [(3, "l8", 5001)]


SCORES = [(0, 1, 100), (1, 1, 100), (1, 2, 100), (2, 1, 90), (2, 2, 95), (3, 2, 80), (3, 3, 80), (4, 0, 70), (4, 3, 90), (5, 3, 60), (6, 1, 100), (6, 2, 100)]


def scores(spark, pool="all"):
    return spark.createDataFrame(SCORES, "rid long, fid long, raw long").withColumn("pool", F.lit(pool))


def dense_em(prior, steps, k=4):
    """The formulas on dense arrays."""
    q = np.zeros((7, k))
    for r, f, v in SCORES:
        q[r, f] = np.expm1(v)
    y, w = (q > 0).sum(axis=1) > 1, q.max(axis=1)
    pi = theta = np.full(k, 1 / k)
    for _ in range(steps):
        z = q * pi * np.where(y[:, None], theta, 1)
        z /= z.sum(axis=1, keepdims=True)
        t = (z * (w * y)[:, None]).sum(axis=0)
        tp = prior * w.max()
        pi, theta = ((q * ~y[:, None]).sum(axis=0) + t) / w.sum(), (t + tp) / ((w * y).sum() + tp * k)
    return pi, z


@pytest.mark.parametrize("prior", [200_000.0, 0.0])
def test_em_agrees_with_dense(spark, prior):
    o = em.Options(4, theta_prior=prior, max_iter=8, epsilon=0)
    p = em.fit(scores(spark), o)
    pi, z = dense_em(prior, 8)
    assert [r.pi for r in p.orderBy("fid").collect()] == pytest.approx(pi, abs=1e-12)
    for r in em.posteriors(scores(spark), p).collect():
        assert r.z == pytest.approx(z[r.rid, r.fid], abs=1e-10)


def test_em_converges_without_prior(spark):
    p = em.fit(scores(spark), em.Options(4, theta_prior=0.0)).orderBy("fid").collect()
    assert p[0].iterations == 8
    assert [round(r.pi, 10) for r in p] == pytest.approx([0, 0.9999849, 0, 0.000015099], abs=1e-8)
    assert p[0].lnl == pytest.approx(565.30441993, abs=1e-6)


def test_em_many_pools_equals_few(spark, monkeypatch):
    both = scores(spark, "a").unionByName(scores(spark, "b"))
    few = rows(em.fit(both, em.Options(4)).select("pool", "fid", F.round("pi", 12), "iterations"))
    monkeypatch.setattr(em, "FEW_POOLS", 1)
    assert rows(em.fit(both, em.Options(4)).select("pool", "fid", F.round("pi", 12), "iterations")) == few


def test_em_of_nothing(spark):
    assert em.fit(scores(spark).limit(0), em.Options(4)).count() == 0


def test_reassignment(spark):
    z = em.posteriors(scores(spark), em.fit(scores(spark), em.Options(4)))
    want = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 1}
    for mode in ("best_exclude", "best_random", "best_average"):
        assert {r.rid: r.fid for r in reassign.reassign(z, mode).collect()} == want
    assert {r.rid for r in reassign.reassign(z, "best_conf", 0.95).collect()} == {0, 1, 2, 4, 5, 6} - {2} | ({2} if z.where("rid = 2 and z > 0.95").count() else set())
    assert {r.rid for r in reassign.reassign(z, "unique").collect()} == {0, 5}
    assert reassign.reassign(z, "total_hits").count() == 12
    picked = {r.rid: r.fid for r in reassign.reassign(z, "initial_random").collect()}
    assert picked[2] == 2 and picked[4] == 3 and set(picked) == set(range(7))
    with pytest.raises(ValueError):
        reassign.reassign(z, "other")


@pytest.mark.parametrize(
    ("cells", "comps", "reps"),
    [
        ([(0, 1, 10), (1, 1, 10)], {0: 0, 1: 0}, {1}),
        ([(0, 1, 50), (0, 2, 50), (1, 2, 40), (2, 3, 60)], {0: 0, 1: 0, 2: 2}, {1, 2}),
        ([(0, 1, 10), (1, 1, 5), (1, 2, 5), (2, 2, 10)], {0: 0, 1: 0, 2: 0}, {2}),
    ],
)
def test_molecules(spark, cells, comps, reps):
    s = spark.createDataFrame(cells, "rid long, fid long, raw long")
    r = s.select("rid").distinct().withColumn("bc", F.lit("A")).withColumn("umi", F.lit("U"))
    c = umi.components(r, s)
    assert {x.rid: x.comp for x in c.collect()} == comps
    assert {x.rid for x in umi.representatives(c, s).collect()} == reps


@pytest.mark.parametrize(("counts", "bins"), [([1, 2], {"1": 1, ">1": 1}), ([1, 7, 3], {"1": 1, "3": 1, "6-10": 1}), ([30, 12, 6], {">20": 1, "11-20": 1, "6-10": 1}), ([12, 1], {">10": 1, "1": 1})])
def test_histogram(spark, counts, bins):
    df = spark.createDataFrame([(n,) for n in counts], "n int")
    assert dict(rows(umi.histogram(df))) == bins


def test_cigar_and_pairs(spark):
    a = spark.createDataFrame([("q", 99, "c", 101, 60, "10M5N10M1I2M", "=", 201, 120, "*", "*", {"AS": "30"}, 0), ("q", 147, "c", 201, 60, "3S20M", "=", 101, -120, "*", "*", {"AS": "20"}, 1), ("s", 0, "c", 5, 60, "4M", "*", 0, 0, "*", "*", {"AS": "4"}, 2)], "qname string, flag int, ref string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, file_seq long")
    a = a.withColumn("rnext", F.when(F.col("rnext") == "=", F.col("ref")).otherwise(F.col("rnext")))
    p = fragments.pair_metrics(fragments.pair_mates(a.where("qname = 'q'"))).collect()
    assert len(p) == 1 and p[0].r1.flag == 99 and p[0].r2.flag == 147
    assert [tuple(b) for b in p[0].blocks] == [(100, 110), (115, 127), (200, 220)] and p[0].alnlen == 42 and p[0].alnscore == 50
    assert dict((r.qname, r.code) for r in fragments.fragment_codes(a).collect()) == {"q": "PM", "s": "SM"}


def test_scalars(spark):
    df = spark.createDataFrame([(0.9, 10.0, 2356743467.0, "chr1:200-100", "7")], "p double, q double, n double, r string, s string")
    r = df.select(scalars.phred(F.col("p")).alias("a"), scalars.phred(F.lit(1.0)).alias("b"), scalars.phred(F.lit(0.999999)).alias("c"), scalars.eprob(F.col("q")).alias("d"), scalars.human_format(F.col("n")).alias("e"), scalars.region(F.col("r")).alias("f"), scalars.coerced(F.col("s")).alias("g")).first()
    assert (r.a, r.b, r.c) == (10, 255, 60) and math.isclose(r.d, 0.9) and r.e == "2.4G" and tuple(r.f) == ("chr1", 100, 200) and r.g.i == 7
