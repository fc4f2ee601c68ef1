"""Vectors, documents and passages that repeat, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.llm import embeddings, minhash, substring
from locusmill.llm.common import Scratch, components, hashes

SF = "/root/testdata/sf0.001"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i]], i % 3) for i in range(40)]
    for i in range(40, 130):
        src = base[i % 7]
        rows.append((i, [float(x) for x in src + rng.standard_normal(16) * 0.08], (i % 7) % 3))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [None, 1.0], 0), (207, [1e300, 1e300], 0), (208, [1.0, 1.0], 0), (209, [], 1), (200, rows[0][1], 0)]
    return rows


def brute_vectors(rows, threshold=0.93):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.max(np.abs(v))
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    links = {i: [j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and rows[i][2] is not None and rows[i][2] == rows[j][2] and u @ w >= threshold] for i, u in enumerate(units)}
    comp = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(rows[j][0] for j in seen)
    return sorted((r[0], len(links[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [512, 8])
def test_vectors(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("key", F.lit(1))
    got = sorted(tuple(r) for r in embeddings.near_vectors(df, block=block).collect())
    assert got == brute_vectors(rows)


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def documents(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        rows.append(" ".join(rng.choice(words, 80 + i)))
    for i in range(60):
        w = rows[i % 4].split()
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = f"x{rng.integers(0, 99)}"
        rows.append(" ".join(w))
    passage = " ".join(rng.choice(words, 60))
    rows += [f"{rows[9]} {passage}", f"{passage} {rows[10]}", "a b a b " * 40, "a b a b " * 60, rows[0], rows[0], rows[0].replace(" ", "\n"), "", None, " \t", "one", "one", "two words", "ä ö ü " * 30]
    rows.append(" ".join(rng.choice(words, 30_000)))
    return list(enumerate(rows))


def brute_near(rows, threshold=0.8):
    sets = [minhash.shingles(hashes((t or "").encode().split())) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {r[0]: rows[find(i)][0] for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [512, 4])
def test_near_documents(spark, block):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("node", F.lit("x")).withColumn("tkey", F.lit(1))
    assert {r.doc_id: r.class_id for r in minhash.near_classes(df, block=block).collect()} == brute_near(rows)


def test_probability_jaccard():
    """Registers agree as often as the exact similarity says; the similarity follows its definition."""
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    a, b = (h[:50], rng.integers(1, 5, 50)), (h[10:], rng.integers(1, 5, 50))
    wa, wb = dict(zip(a[0].tolist(), a[1].tolist())), dict(zip(b[0].tolist(), b[1].tolist()))
    want = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in {*wa, *wb}) for d in {*wa} & {*wb})
    assert minhash.similarity(a, b) == pytest.approx(want)
    sig = minhash.signatures([a, b], 8192)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)
    again = minhash.signatures([(a[0][::-1], a[1][::-1]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))], 8192)
    assert (again[0] == sig[0]).all() and not again[1].any()


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, None, "s"), (4, "", None), (None, "a b c d e f g", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id is None, r.doc_id) for r in minhash.keep_one(df).collect()) == [(False, 1), (False, 3), (False, 4), (True, None)]
    assert minhash.keep_one(df.limit(0)).count() == 0


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 8, 5, 11])
def test_repeats(spark, window):
    rows = documents(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in substring.dedup_digests(df, window).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], window)))


def test_remove_repeats(spark):
    line = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"start {line}\nend", 7, "x"), (2, f"{line} other", 1, "y"), (3, "short  text", 11, "y"), (4, None, None, None), (None, f"a {line}", 3, "z")], "doc_id long, text string, n_chars long, kept_ string")
    got = {r.doc_id: (r.text, r.n_chars, r.kept_) for r in substring.remove_repeats(df).collect()}
    assert got == {1: ("start end", 9, "x"), 2: ("other", 5, "y"), 3: ("short  text", 11, "y"), 4: (None, None, None), None: ("a", 1, "z")}
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_levels():
    assert substring.levels(35, 8) == [8, 16, 32, 35] and substring.levels(8, 8) == [8] and substring.levels(5, 8) == [5]
    w = np.arange(50, dtype=np.uint64)
    assert (substring.window_hashes(w, 35)[3] == substring.window_hashes(w[3:38], 35)).all()
    x = np.array([5, 3, 3, 9, 1, 7], dtype=np.uint64)
    assert substring.smallest(x, 3).tolist() == [1, 1, 4, 4]


@pytest.mark.parametrize("shape", ["rising", "shuffled", "star", "grid"])
def test_components(spark, shape):
    """A chain of 5000, whatever its order, ends in under 20 rounds; labels are the smallest nodes."""
    rng = np.random.default_rng(2)
    n = 5000 if shape != "grid" else 900
    ids = np.arange(n) if shape == "rising" else rng.permutation(n)
    if shape == "star":
        pairs = [(ids[0], x) for x in ids[1:4000]]
    elif shape == "grid":
        pairs = [(ids[i], ids[i + d]) for i in range(n) for d in (1, 30) if i + d < n and (d > 1 or (i + 1) % 30) and i // 30 not in (9, 20) and (i + d) // 30 not in (9, 20)]
    else:
        pairs = [(ids[i], ids[i + 1]) for i in range(n - 1) if i != 3000]
    links = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long")
    scratch, kept = Scratch(spark, "chain"), []
    keep = scratch.keep
    scratch.keep = lambda df, name: kept.append(name) or keep(df, name)
    got = {r.node: r.label for r in components(scratch, links).collect()}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(int(a), []).append(int(b))
        near.setdefault(int(b), []).append(int(a))
    want: dict = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    assert got == want
    assert 0 < len([n for n in kept if "-step" in n]) < 20


def test_recall_on_documents(spark):
    """Every pair of whole texts at 0.8 or more, found by brute force over shared shingles, is in one class; and no class holds what no chain of links joins."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: minhash.shingles(hashes((t or "").encode().split())) for i, t in rows}
    holds: dict = {}
    for i, (h, _) in sets.items():
        for x in h.tolist():
            holds.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holds.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    linked = [(a, b) for a, b in pairs if minhash.similarity(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 30 and sum(got[a] == got[b] for a, b in linked) >= 0.999 * len(linked)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(find(i) == find(c) for i, c in got.items())


@pytest.mark.parametrize("n", [300])
def test_chains(spark, n):
    """Chains of near copies with rising ids, each linked to the next only, are one class."""
    words = [f"w{i}" for i in range(4 * n + 300)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(n)]
    got = {r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {0}
    vecs = []
    for i in range(n):
        corner, rest = divmod(0.3 * i, np.pi / 2)
        v = [0.0] * (n // 5 + 3)
        v[int(corner)], v[int(corner) + 1] = float(np.cos(rest)), float(np.sin(rest))
        vecs.append((i, v, 1))
    got = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == brute_vectors(vecs) and {r[2] for r in got} == {0}
