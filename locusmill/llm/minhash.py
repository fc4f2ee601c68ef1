"""Near-duplicate documents by ProbMinHash over weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import ROW_ID, U64, Scratch, components, hashes, lists, mix, running_total, slices, text_key, with_row_ids

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 6 registers: at similarity 0.8 a pair is missed with probability 6e-5, at 0.85 with 6e-8; at 0.4 it is
#: a candidate with probability 0.1.
BANDS, ROWS = 32, 6
#: Nodes of a block of a bucket.
BLOCK = 256


def shingles(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and counts of the k-word shingles; fewer than k words are one shingle, none are none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, n)
    h = np.full(n - k + 1, U64(k))
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    h = np.sort(mix(h))
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, len(h)))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash registers of weighted sets, one row each (sets without elements: zeros).

    Element d of weight w gives a Poisson process of rate w, all draws being functions of d; each arrival goes to a
    random register, which keeps the element of its earliest arrival. Two sets' registers agree with the probability
    of their probability Jaccard similarity. Arrivals are drawn up to a time at which all registers are filled almost
    surely; a later one could change nothing then, and sets with a register still open go on with twice that time.
    """
    sig = np.zeros((len(docs), m), np.uint64)
    todo = [i for i, (h, _) in enumerate(docs) if len(h)]
    factor = np.log(m) + 2.5
    while todo:
        sizes = np.array([len(docs[i][0]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        d = np.concatenate([docs[i][0] for i in todo])
        w = np.concatenate([docs[i][1] for i in todo]).astype(np.float64)
        limit = (m * factor / np.bincount(owner, w, len(todo)))[owner]
        x = np.zeros(len(d))
        seed = d
        times, regs, who = [], [], []
        while len(d):
            seed = mix(seed + U64(0x9E3779B97F4A7C15))
            x = x - np.log(uniform(seed)) / w
            ok = x < limit
            d, w, limit, x, seed, owner = d[ok], w[ok], limit[ok], x[ok], seed[ok], owner[ok]
            if len(d):
                reg = (mix(seed ^ U64(0xD1B54A32D192ED03)) % U64(m)).astype(np.int64)
                times.append(x)
                regs.append(owner * m + reg)
                who.append(d)
        t, r, e = np.concatenate(times), np.concatenate(regs), np.concatenate(who)
        least = np.full(len(todo) * m, np.inf)
        np.minimum.at(least, r, t)
        won = least[r] == t
        out = np.zeros(len(todo) * m, np.uint64)
        np.maximum.at(out, r[won], e[won])
        full = np.isfinite(least).reshape(len(todo), m).all(axis=1)
        out = out.reshape(len(todo), m)
        sig[np.array(todo)[full]] = out[full]
        todo = [i for i, f in zip(todo, full.tolist(), strict=True) if not f]
        factor *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)) * U64(0xA0761D6478BD642F)
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (plain Jaccard where all weights are 1)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    only_a, only_b = float(a[1].sum() - wa.sum()), float(b[1].sum() - wb.sum())
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(ia) + only_a + only_b)
    pairs, many = np.unique(np.stack([wa, wb]), axis=1, return_counts=True)
    p, q = pairs
    per = np.array([(np.maximum(p / x, q / y) * many).sum() + only_a / x + only_b / y for x, y in zip(p, q, strict=True)])
    return float((many / per).sum())


def banded(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch):
                sets = [shingles(hashes(t.split()), k) for t in texts]
                sig = signatures(sets, bands * rows)
                has = np.array([len(h) > 0 for h, _ in sets])
                keys = band_keys(sig, bands, rows)[has].view(np.int64).ravel()
                part = batch.slice(lo, hi - lo)
                low = pa.array([x.tobytes() if h else None for x, h in zip(sig.astype(np.uint8), has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(keys, [bands * int(x) for x in has]), low], names=["tkey", "doc_id", "keys", "regs"])

    return run


def verified(k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for df in batches:
            keep = []
            for a, ta, tb in zip(df["a"].tolist(), df["ta"].tolist(), df["tb"].tolist(), strict=True):
                if (a, ta) != last or known is None:
                    last, known = (a, ta), shingles(hashes((ta or "").encode().split()), k)
                keep.append(similarity(known, shingles(hashes((tb or "").encode().split()), k)) >= threshold - 1e-9)
            yield df.loc[keep, ["a", "b"]]

    return run


def linked(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose whole texts have a similarity of `threshold` or more."""
    t = texts.select(F.col("node"), F.col("text"))
    both = pairs.join(t.withColumnsRenamed({"node": "b", "text": "tb"}), "b").join(t.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(verified(k, threshold), "a long, b long")


def least_agreement(threshold: float, registers: int) -> float:
    """Registers in which a pair of the threshold's similarity agrees at least, but for 4.5 standard deviations."""
    return registers * threshold - 4.5 * np.sqrt(registers * threshold * (1 - threshold))


def likely(threshold: float, registers: int):
    """Pairs (a, b, x, y) whose registers x and y agree as often as the threshold asks for."""
    least = least_agreement(threshold, registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, registers) for k in (2, 3))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


#: A group of a bucket: two of its blocks. Rows of a group come together.
GROUP = ("key", "i", "j")


def grouped(names: list[str], work, kind: list[tuple[str, pa.DataType]]):
    """Runs of rows of one group, as a dictionary of lists, to the rows that `work` gives, as tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            got = work(held) if len(held["node"]) > 1 else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*got, strict=True), kind, strict=True)], names=[n for n, _ in kind])
            for v in held.values():
                v.clear()

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if row[:3] != last:
                    yield from done()
                    last = row[:3]
                for n, v in zip(names, row, strict=True):
                    held[n].append(v)
        yield from done()

    return run


def open_pairs(held: dict[str, list], threshold: float, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group, the pairs between its two blocks (within its block, if it is one) that have different labels, registers
    that agree often enough, and no earlier band in common: places p and q, and how many registers agree."""
    label, own = np.array(held["label"]), np.array(held["own"])
    regs = np.frombuffer(b"".join(held["regs"]), np.uint8).reshape(-1, bands * rows)
    keys = np.array(held["keys"], dtype=np.int64)
    least = least_agreement(threshold, bands * rows)
    one = held["i"][0] == held["j"][0]
    left = np.flatnonzero(own == held["i"][0])
    right = left if one else np.flatnonzero(own == held["j"][0])
    found = [(np.zeros(0, np.int64),) * 3]
    for x in range(0, len(left) if len(right) else 0, 32):
        part = left[x : x + 32]
        same = (regs[part][:, None, :] == regs[right][None, :, :]).sum(axis=2)
        p, q = np.nonzero((same >= least) & (label[part][:, None] != label[right][None, :]))
        keep = part[p] < right[q] if one else np.ones(len(p), bool)
        found.append((part[p][keep], right[q][keep], same[p, q][keep]))
    p, q, count = (np.concatenate(c) for c in zip(*found, strict=True))
    band = int(np.flatnonzero(keys[0] == held["key"][0])[0])
    mine = np.concatenate([~(keys[p[k : k + 50_000], :band] == keys[q[k : k + 50_000], :band]).any(axis=1) for k in range(0, len(p), 50_000)]) if len(p) else np.zeros(0, bool)
    return p[mine], q[mine], count[mine]


def in_open_pairs(threshold: float, bands: int, rows: int):
    """Groups, without texts, to the nodes that open pairs need."""

    def work(held: dict[str, list]) -> list[tuple]:
        p, q, _ = open_pairs(held, threshold, bands, rows)
        return [(held["key"][0], held["i"][0], held["j"][0], held["own"][x], held["node"][x]) for x in np.unique(np.concatenate([p, q])).tolist()]

    return grouped([*GROUP, "own", "node", "label", "regs", "keys"], work, [("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("node", pa.int64())])


def resolved(k: int, threshold: float, bands: int, rows: int):
    """Groups with texts to links (a, b) that join what had different labels.

    Open pairs are held against each other exactly, likeliest first, unless links found before in the group have
    already joined their components.
    """

    def work(held: dict[str, list]) -> list[tuple]:
        node, label = held["node"], held["label"]
        p, q, count = open_pairs(held, threshold, bands, rows)
        sets: dict[int, tuple] = {}
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def words(x: int) -> tuple:
            if x not in sets:
                sets[x] = shingles(hashes((held["text"][x] or "").encode().split()), k)
            return sets[x]

        out = []
        for at in np.argsort(-count, kind="stable").tolist():
            x, y = int(p[at]), int(q[at])
            u, v = find(label[x]), find(label[y])
            if u != v and similarity(words(x), words(y)) >= threshold - 1e-9:
                root[max(u, v)] = min(u, v)
                out.append((node[x], node[y]))
        return out

    return grouped([*GROUP, "own", "node", "label", "regs", "keys", "text"], work, [("a", pa.int64()), ("b", pa.int64())])


def in_groups(member: DataFrame, block: int) -> DataFrame:
    """Rows (key, node, label) of buckets with several labels to (key, i, j, own, node, label).

    The nodes of a bucket's commonest label need not meet each other, so they lie in blocks of their own, which meet
    only the blocks of the rest; these meet each other too. Blocks hold about `block` nodes, and a group is two of them.
    """
    per = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    per = per.select("key", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.c")) / block).cast("int").alias("r"), F.ceil(F.col("top.c") / block).cast("int").alias("m"))
    dealt = member.join(per, "key").withColumn("is_top", F.col("label") == F.col("top"))
    draw = F.xxhash64("node", F.lit(5))
    own = F.when(F.col("is_top"), F.col("r") + F.pmod(draw, F.col("m"))).otherwise(F.pmod(draw, F.col("r"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("r")).otherwise(F.col("r") + F.col("m")) - 1)))
    return dealt.select("key", F.least("own", "with").cast("int").alias("i"), F.greatest("own", "with").cast("int").alias("j"), "own", "node", "label")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id (smallest doc_id reachable by links), kept.

    Two documents are linked if their texts are equal or the probability Jaccard similarity of their shingles of k
    words, weighted by their counts, is at least `threshold`. Equal texts are one node, the smallest doc_id among
    them. Nodes that share the key of a band are candidates; those whose registers agree too seldom are left (a pair
    at the threshold with probability 3e-6). First every node is held against one node of each of its buckets, the one
    that shares most buckets with most nodes. What this leaves in different components of a bucket meets in it by
    blocks of about `block` nodes (see in_groups): registers first, then the texts of those that need it. A pair is
    looked at in the first band that it shares. So no link between components is lost, and no pairs leave a task but
    those with the bucket's chosen node and the few that join something.

    Null and empty texts have no shingles, link with nothing and are classes of their own. Rows that share a doc_id
    are one document; rows without one have no class (null) and are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    src = docs.select(text_key().alias("tkey"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.keep(src.mapInArrow(banded(k, bands, rows), "tkey binary, doc_id long, keys array<long>, regs binary"), "signatures")
    nodes = sig.where("size(`keys`) > 0 and doc_id is not null").groupBy("tkey").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("regs").alias("regs"))
    nodes = scratch.keep(nodes, "nodes")
    each = nodes.select("node", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = scratch.keep(each.join(shared, "key").select("key", "node", "n"), "member")
    centre = member.groupBy("node").agg(F.sum("n").alias("w"))
    most = F.max(F.struct(F.col("w"), (-F.col("node")).alias("z")))
    chosen = scratch.keep(member.join(centre, "node").groupBy("key").agg((-most["z"]).alias("chosen")), "chosen")
    pairs = member.join(chosen, "key").where("node <> chosen").select(F.least("node", "chosen").alias("a"), F.greatest("node", "chosen").alias("b")).distinct()
    regs = nodes.select("node", "regs")
    both = pairs.join(regs.withColumnsRenamed({"node": "a", "regs": "x"}), "a").join(regs.withColumnsRenamed({"node": "b", "regs": "y"}), "b")
    pairs = scratch.keep(both.select("a", "b", "x", "y").mapInArrow(likely(threshold, bands * rows), "a long, b long"), "pairs")
    # Texts of all nodes that share a band with another, so that the documents are read for them once.
    first = nodes.select(F.col("tkey").alias("k_"), "node").join(member.select("node").distinct(), "node")
    texts = src.join(first, (F.col("tkey") == F.col("k_")) & (F.col("doc_id") == F.col("node"))).select("k_", "node", "text").dropDuplicates(["k_", "node"])
    texts = scratch.keep(texts, "texts")
    links = scratch.keep(linked(pairs, texts, k, threshold), "links")
    # Rows that share a doc_id are one document though their texts, and so their nodes, may differ.
    same = sig.where("doc_id is not null").join(nodes.select("tkey", "node"), "tkey").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    other = same.join(sig.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("tkey").alias("n")).where("n > 1").select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b").distinct()
    links = links.union(other)
    label = components(scratch, links, "round1")
    now = member.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    groups = scratch.keep(in_groups(now, block), "groups")
    order = list(GROUP)
    known = groups.join(nodes.select("node", "regs", "keys"), "node").where(F.array_contains("keys", F.col("key"))).repartition(*order).sortWithinPartitions(*order, "node")
    asked = scratch.keep(known.mapInArrow(in_open_pairs(threshold, bands, rows), "key long, i int, j int, own int, node long"), "asked")
    whole = nodes.select(F.col("tkey").alias("k_"), "node", "regs", "keys").join(texts.join(asked.select("node").distinct(), "node"), ["k_", "node"])
    more = asked.join(groups, [*order, "own", "node"]).join(whole, "node").where(F.array_contains("keys", F.col("key")))
    more = more.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(resolved(k, threshold, bands, rows), "a long, b long")
    label = components(scratch, links.union(scratch.keep(more, "more")), "round2")
    scratch.drop("member", "chosen", "pairs", "texts", "links", "groups", "asked", "more", "round1-labels")  # what follows reads none of them
    named = sig.select("tkey", "doc_id").join(nodes.select("tkey", "node"), "tkey", "left").join(label, "node", "left")
    out = named.select("doc_id", F.coalesce("label", "node", "doc_id").alias("class_id"))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, null_ids: bool = True) -> DataFrame:
    """One row of docs for each class of near duplicates, see near_classes: of the smallest doc_id the first row with words.

    Rows that share a doc_id are one document. Rows without one stay if `null_ids`; else each is a document of its own
    that comes after those with ids, and goes if its class has another. Null and empty texts are alone in their classes.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    rows = with_row_ids(docs, scratch)
    id_, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    own = rows.select(id_, text, *ROW_ID, F.lit(0).alias("late"))
    named = own.where("doc_id is not null")
    low, high, n = own.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if n and not null_ids:
        # Numbers that no doc_id has.
        before = (high or 0) if (high or 0) + n < 1 << 63 else low - n - 1
        loose = running_total(scratch, own.where("doc_id is null").withColumn("one", F.lit(1)), "loose", [F.col(c) for c in ROW_ID], "one", out="nth")
        named = named.union(loose.select((F.lit(before) + F.col("nth")).alias("doc_id"), "text", *ROW_ID, F.lit(1).alias("late")))
        named = scratch.keep(named, "named")
    classes = near_classes(named.select("doc_id", "text"), threshold).groupBy(F.col("doc_id").alias("d_")).agg(F.min("class_id").alias("class_id"))
    blank = ~F.col("text").rlike(r"\S")
    first = named.groupBy("late", "doc_id").agg(F.min(F.struct(blank.alias("blank"), *ROW_ID)).alias("row"))
    one = first.join(classes, F.col("doc_id") == F.col("d_")).groupBy("class_id").agg(F.min(F.struct("late", "doc_id", "row")).alias("best"))
    stay = one.select(*(F.col(f"best.row.{c}").alias(c) for c in ROW_ID))
    gone = scratch.keep(named.select(*ROW_ID).join(stay, list(ROW_ID), "left_anti"), "gone")
    return rows.join(gone, list(ROW_ID), "left_anti").select(*docs.columns)
