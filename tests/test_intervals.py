"""Interval joins and the pieces that the queries don't reach, by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from locusmill.operators import em, intervals, segments, umi
from locusmill.scratch import Scratch, sweep


@pytest.mark.parametrize("seed", [1, 2])
def test_range_join_of_all_lengths(spark, seed):
    """Short and very long intervals meet as brute force says, each pair once."""
    rng = random.Random(seed)

    def made(n):
        out = []
        for i in range(n):
            size = rng.choice([0, 1, 7, 128, 129, 5000, 200_000, 100_000_000])
            at = rng.randrange(0, 100_000_000) if size > 5000 else rng.randrange(0, 3000)
            out.append((i, rng.choice("ab"), at, at + size))
        return out

    a, b = made(150), made(150)
    left = spark.createDataFrame(a, "x long, chrom string, ls long, le long")
    right = spark.createDataFrame(b, "y long, chrom string, rs long, re long")
    got = sorted((r.x, r.y) for r in intervals.range_join(left, right, ["chrom"], "ls", "le", "rs", "re").collect())
    assert got == sorted((x, y) for x, c, s, e in a for y, d, t, f in b if c == d and max(s, t) < min(e, f))


def test_long_intervals_are_few_rows(spark):
    """An interval of a hundred million bases isn't dealt to hundreds of thousands of bins."""
    one = spark.createDataFrame([("a", 0, 100_000_000)], "chrom string, rs long, re long")
    left = spark.createDataFrame([("a", 5, 60)], "chrom string, ls long, le long")
    joined = intervals.range_join(left, one, ["chrom"], "ls", "le", "rs", "re")
    assert joined.count() == 1


def test_sparse_parameters(spark, monkeypatch):
    """Features without data are one row, and posteriors are the same."""
    monkeypatch.setattr(em, "FEW_POOLS", 0)
    rows = [(f"p{p}", r, f, 10 + (r * f + p) % 7) for p in range(3) for r in range(8) for f in {r % 5, (r * 3) % 5}]
    scores = spark.createDataFrame(rows, "pool string, rid long, fid long, raw long")
    whole, few = (em.fit(scores, em.Options(50, sparse=s)) for s in (False, True))
    assert whole.count() == 150 and few.count() == 3 * 6 and few.where("fid = -1").count() == 3
    other = {r.pool: r.pi for r in few.where("fid = -1").collect()}
    assert all(r.pi == other[r.pool] for r in whole.where("fid > 5").collect())
    a, b = ({(r.pool, r.rid, r.fid): r.z for r in em.posteriors(scores, p).collect()} for p in (whole, few))
    assert a == pytest.approx(b)


def test_one_molecule_of_each_kind(spark):
    """Shared features, chains without a common feature, and strangers, with and without Python."""
    reads = spark.createDataFrame([(r, "A", u) for r, u in enumerate(["x"] * 3 + ["y"] * 3 + ["z"] * 2 + ["w"])], "rid long, bc string, umi string")
    cells = [(0, 1), (1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (4, 2), (5, 2), (6, 0), (7, 0), (8, 3)]
    scores = spark.createDataFrame([(r, f, 5) for r, f in cells], "rid long, fid long, raw long")
    got = {r.rid: r.comp for r in umi.components(reads, scores).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}
    assert sorted((r.umi, r.shared) for r in umi.common_feature(scores.join(reads, "rid")).collect()) == [("w", True), ("x", True), ("y", False), ("z", False)]


def test_tags_set_and_removed(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "t map<string,string>")
    row = df.select(segments.set_tag(F.col("t"), "a", F.lit("9")).alias("s"), segments.set_tag(F.col("t"), "b", None).alias("r")).first()
    assert row.s == {"a": "9", "b": "2"} and row.r == {"a": "1"}


def test_sweep(spark):
    base = Scratch(spark, "sweep")
    base.keep(spark.range(3), "t")
    kept = spark.sparkContext._locusmill_bases
    spark.sparkContext._locusmill_bases = [base.base]
    assert sweep(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{base.base}/t").count()
    spark.sparkContext._locusmill_bases = kept
