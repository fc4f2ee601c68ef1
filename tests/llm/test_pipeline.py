"""The pipeline's stages on the smallest documents, against brute-force versions of each."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusmill.llm import minhash, packing
from locusmill.llm.common import hashes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    texts = [dict(map(tuple, d.select("doc_id", "text").collect())) for d in kept[:4]]
    # quality: what goes is a few documents, and those labelled good stay
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in texts[1] for i in good) >= 0.95 * len(good)
    # near duplicates: the smallest of each class stays
    ids = sorted(texts[1])
    sets = {i: minhash.shingles(hashes((texts[1][i] or "").encode().split())) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and minhash.similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(texts[2]) == {find(i) for i in ids}
    # repeated passages
    words = {i: (t or "").split() for i, t in texts[2].items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[2][i]
        assert texts[3][i] == want
    # mixing: copies of documents, as many words as there were at most
    mixed = kept[4].groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 and r.doc_id in texts[3] for r in mixed)
    total = sum(len((t or "").split()) for t in texts[3].values())
    taken = sum(r["count"] * len((texts[3][r.doc_id] or "").split()) for r in mixed)
    assert 0.95 * total <= taken <= total
    # packing
    packed = kept[5].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter({r.doc_id: r["count"] for r in mixed})
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // packing.CAPACITY)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b", None, "s", 3)]
    docs = spark.createDataFrame(rows, schema).withColumn("size", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, SF).collect()


def test_repeated_rows(spark):
    """Repeated and id-less copies go, and one row of each group reaches the mix with its text."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1), (None, a, "en", "s", 1), (5, "", "en", "s", 0), (5, b, "en", "s", 1), (5, b, "en", "s", 1)]
    rows += [(None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, f"{c} end", "en", "t", 1), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = corpus_pipeline.distinct_documents(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(k for k in kept if k[0] is not None) == [(1, a), (5, b), (7, "")]
    loose = [t for i, t in kept if i is None]
    assert len(loose) == 3 and {t for t in loose if t} < {c, f"{c} end"} and len([t for t in loose if t]) == 1
    after = corpus_pipeline.without_repeats(spark, got, SF)
    assert sorted(map(str, after.select("doc_id", "text").collect())) == sorted(map(str, got.select("doc_id", "text").collect()))


@pytest.mark.parametrize("most", [2**63 - 1, 9])
def test_ids_at_the_end(spark, most):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(most, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (None, "g h i j k l", "en", "s", 1)]
    got = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "g h i j k l"), (most, "a b c d e f")]
