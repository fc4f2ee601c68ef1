"""Rows of a task: they stay as many when the input grows, whatever few bytes they take."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusmill.operators import dealing, em, matrix, umi


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def largest_share(df):
    """The rows of the largest part against all rows."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture
def alignments(spark, tmp_path, monkeypatch):
    """Alignments of 4000 rows in a file that is worth 16 parts."""
    a = spark.range(4000).select((F.col("id") % 1000).alias("rid"), (F.col("id") % 7).alias("fid"), F.lit(5).alias("sc"), F.lit(10).alias("len"))
    a.coalesce(1).write.parquet(f"{tmp_path}/a")
    size = max(f.stat().st_size for f in (tmp_path / "a").glob("*.parquet"))
    monkeypatch.setattr(dealing, "PART_BYTES", -(-size // 16))
    return spark.read.parquet(f"{tmp_path}/a")


def test_scores_and_differences_are_dealt_by_size(alignments):
    m = matrix.score_matrix(alignments)
    assert largest_share(m) < 0.2
    assert largest_share(matrix.differences(m.where("fid <> 3"), m.where("fid <> 2"))) < 0.2


def test_differences_count_copies(spark, monkeypatch):
    monkeypatch.setattr(matrix, "TURN", 2, raising=False)
    a = spark.createDataFrame([(1, None)] * 6 + [(2, 5), (3, 7)], "rid long, raw long")
    b = spark.createDataFrame([(1, None), (2, 5), (2, 5), (4, 1)], "rid long, raw long")
    got = {(r.rid, r.side): r["count"] for r in matrix.differences(a, b).groupBy("rid", "side").count().collect()}
    assert got == {(1, "left"): 5, (2, "right"): 1, (3, "left"): 1, (4, "right"): 1}


def test_small_pools_are_fitted_together(monkeypatch):
    """Two thousand pools of three rows take a few passes of numpy, not some for each pool."""
    made = []
    init = em.Csr.__post_init__
    monkeypatch.setattr(em.Csr, "__post_init__", lambda self: (made.append(1), init(self))[1])
    names = [f"p{i // 3:05}" for i in range(6000)]
    rows = pa.table({"pool": names, "fids": [[i % 4, 4 + i % 3] for i in range(6000)], "raws": [[5 + i % 9, 8] for i in range(6000)], "many": [1] * 6000})
    batches = rows.to_batches(max_chunksize=1000)
    got = pa.Table.from_batches(list(em.fit_each(em.Options(9))(iter(batches))))
    assert got.num_rows == 2000 * 9 and len(set(got["pool"].to_pylist())) == 2000
    assert len(made) < 20


@pytest.mark.parametrize("options", [{}, {"use_likelihood": True}, {"theta_prior": 0.0, "pi_prior": 0.5}, {"theta_prior": 0.0, "max_iter": 0}, {"theta_prior": 0.0, "epsilon": 1e-3}])
def test_pools_end_each_by_itself(spark, monkeypatch, options):
    """Pools of several sizes, fitted together in tables that end within a pool, are as fitted pass by pass."""
    cells = [(f"p{p}", r, f, 10 + (r * f + p) % 7) for p in range(7) for r in range(2 + 5 * p) for f in {r % 5, (r * 3 + p) % 5}]
    scores = spark.createDataFrame(cells, "pool string, rid long, fid long, raw long")
    o = em.Options(6, **options)
    want = em.fit(scores, o).orderBy("pool", "fid").collect()
    monkeypatch.setattr(em, "FEW_POOLS", 1)
    monkeypatch.setattr(em, "GIVEN", 13)
    got = em.fit(scores, o).orderBy("pool", "fid").collect()
    assert [(r.pool, r.fid, r.iterations) for r in got] == [(r.pool, r.fid, r.iterations) for r in want]
    for c in ("pi_before", "theta_before", "pi", "theta", "lnl"):
        np.testing.assert_allclose([r[c] for r in got], [r[c] for r in want], rtol=1e-9, atol=1e-12)


def test_common_features_are_dealt_by_size(alignments):
    cells = alignments.select((F.col("rid") % 300).alias("bc"), (F.col("rid") % 300).cast("string").alias("umi"), "rid", "fid")
    got = umi.common_feature(cells)
    assert got.count() == 300 and largest_share(got) < 0.2


def test_common_features_of_copies_and_missing_keys(spark):
    """Cells that come twice count once; keys with a null are counted, and their reads share nothing."""
    cells = [("a", "u", 1, 3), ("a", "u", 1, 3), ("a", "u", 2, 3), ("a", "u", 2, 0), ("b", "u", 3, 3), ("b", "u", 3, 3), ("b", "u", 4, 5), (None, "u", 5, 3), (None, "u", 6, 3), ("c", None, 7, 0)]
    got = umi.common_feature(spark.createDataFrame(cells, "bc string, umi string, rid long, fid long")).collect()
    assert {(r.bc, r.umi): (r.least, r.shared) for r in got} == {("a", "u"): (1, True), ("b", "u"): (3, False), (None, "u"): (5, False), ("c", None): (7, True)} and len(got) == 4


def by_hand(cells):
    """Components of (bc, umi, rid, fid) by joining until nothing changes."""
    comp = {r: r for _, _, r, _ in cells}
    changed = True
    while changed:
        changed = False
        least = {}
        for bc, u, r, f in cells:
            if f > 0 and bc is not None and u is not None:
                least[bc, u, f] = min(least.get((bc, u, f), r), comp[r])
        for bc, u, r, f in cells:
            low = least.get((bc, u, f), comp[r])
            if low < comp[r]:
                comp[r], changed = low, True
    return comp


@pytest.mark.parametrize(("together", "cut"), [(1, 1), (7, 3), (10_000, 1000)])
def test_joined_reads(monkeypatch, together, cut):
    """Chains, rings, strangers and random molecules, in batches that end anywhere; names need not be numbers."""
    monkeypatch.setattr(umi, "TOGETHER", together, raising=False)
    rng = np.random.default_rng(cut)
    cells = [("chain", "x", 100 + i, 1 + j) for i in range(40) for j in ((i * 17) % 40, ((i * 17) % 40) + 1)] + [("apart", "x", 200 + i, 1 + i) for i in range(5)] + [("none", "x", 300 + i, 0) for i in range(3)]
    cells += [("many", f"u{k:02}", 1000 + 10 * k + int(rng.integers(6)), int(rng.integers(5))) for k in range(30) for _ in range(8)]
    table = lambda rid: pa.table({"bc": [c[0] for c in cells], "umi": [c[1] for c in cells], "rid": rid, "fid": [c[3] for c in cells], "comp": pa.nulls(len(cells), rid.type)})
    want = by_hand(cells)
    got = [r for b in umi.join_reads(iter(table(pa.array([c[2] for c in cells])).to_batches(max_chunksize=cut))) for r in b.to_pylist()]
    assert {r["rid"]: r["comp"] for r in got} == want and len(got) == len(want)
    got = [r for b in umi.join_reads(iter(table(pa.array([f"{c[2]:05}" for c in cells])).to_batches(max_chunksize=cut))) for r in b.to_pylist()]
    assert {int(r["rid"]): int(r["comp"]) for r in got} == want


def test_components_are_dealt_by_size(spark, alignments):
    reads = alignments.select("rid", (F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi")).distinct()
    comps = umi.components(reads, alignments.withColumn("raw", F.lit(5)))
    assert comps.count() == 1000 and largest_share(comps) < 0.2
    cells = [tuple(r) for r in alignments.join(reads, "rid").select("bc", "umi", "rid", "fid").collect()]
    assert {r.rid: r.comp for r in comps.collect()} == by_hand(cells)


def test_reads_without_a_key_meet_none(spark):
    """As in SQL: a null is no key, and its reads are there, each for itself."""
    reads = spark.createDataFrame([(1, None, "u"), (2, None, "u"), (3, "a", None), (4, "a", "u")], "rid long, bc string, umi string")
    scores = spark.createDataFrame([(r, 7, 5) for r in (1, 2, 3, 4)], "rid long, fid long, raw long")
    assert rows(umi.components(reads, scores).select("rid", "comp")) == [(r, r) for r in (1, 2, 3, 4)]


def test_corrected_scores_are_dealt_by_size(alignments):
    """The representatives go to where the scores are; the scores stay in their parts."""
    scores = matrix.score_matrix(alignments)
    got = umi.corrected(scores, alignments.select("rid").distinct())
    assert got.count() == scores.count() and largest_share(got) < 0.2


def test_representatives_are_dealt_by_size(alignments):
    comps = alignments.select((F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi"), "rid", F.col("rid").alias("comp")).distinct()
    reps = umi.representatives(comps, alignments.withColumn("raw", F.lit(5)))
    assert reps.count() == 1000 and largest_share(reps) < 0.2


def test_molecules_are_counted_by_size(alignments):
    """Reads and components per molecule, a component being counted by its smallest read."""
    comps = alignments.select((F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi"), "rid", (F.col("rid") % 600).alias("comp")).distinct()
    per = umi.per_key(comps)
    assert largest_share(per) < 0.2
    want = {(r.bc, r.umi): (r.a, r.b) for r in comps.groupBy("bc", "umi").agg(F.count("rid").alias("a"), F.countDistinct("comp").alias("b")).collect()}
    assert {(r.bc, r.umi): (r.reads, r.components) for r in per.collect()} == want
    assert rows(umi.component_summary(comps)) == [(2, 300)]


def test_groups_are_found_by_size(alignments):
    comps = alignments.select((F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi"), "rid", (F.col("rid") % 600).alias("comp")).distinct()
    got = umi.groups_like(comps, 3, 2)
    assert got.count() == 200 and largest_share(got) < 0.2


def test_reads_per_molecule_are_dealt_by_size(alignments):
    reads = alignments.select((F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi"), "rid")
    per = umi.reads_per_umi(reads)
    assert per.agg(F.sum("n")).first()[0] == 1000 and largest_share(per) < 0.2
    comps = reads.distinct().withColumn("comp", F.col("rid") % 600)
    r = umi.whole_summary(per, comps).first()
    assert (r.num_umi, r.max_reads, r.excluded, r.max_components) == (300, 4, 400, 2)


def test_top_components_are_dealt_by_size(spark, alignments):
    reads = alignments.select("rid", (F.col("rid") % 300).alias("bc"), F.concat(F.lit("u"), F.col("rid") % 2).alias("umi")).distinct()
    scores = alignments.select("rid", "fid", (F.col("fid") % 3).alias("raw"))
    top = matrix.top_scores(scores)
    best = {}
    for r, f, v in rows(scores):
        best.setdefault((r, v), set()).add(f)
    most = {}
    for r, v in best:
        most[r] = max(v, most.get(r, v))
    want = {(r, f, v) for (r, v), fs in best.items() if v == most[r] for f in fs}
    assert set(rows(top)) == want
    comps = umi.components(reads, scores, best_score=True)
    cells = [tuple(r) for r in top.join(reads, "rid").select("bc", "umi", "rid", "fid").collect()]
    assert {r.rid: r.comp for r in comps.collect()} == by_hand(cells) and largest_share(comps) < 0.2
