"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import U64, Scratch, components, lists, mix

THRESHOLD = 0.93
#: Projections in a key, tables, and width of a cell; unit vectors of cosine 0.93 lie 0.37 apart, meet in a cell of one
#: projection with probability 0.85, and so miss each other in all tables with probability 2.6e-5, at cosine 0.97 below 1e-11.
PROJECTIONS, TABLES, WIDTH = 14, 96, 2.0
#: Vectors of a bucket that are held against each other at a time; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Rows of groups that a task looks at together, and the size up to which groups are multiplied many at a time.
LOT, SMALL = 16_384, 32
#: Vectors and directions are rounded to these steps: sums of their products are exact, so a key doesn't depend on the
#: order of addition and can be computed anew anywhere.
VECTOR_STEPS, DIRECTION_STEPS = 2.0**22, 2.0**12


@lru_cache(maxsize=8)
def directions(dim: int, projections: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(dim * 1_000_003 + projections * 1009 + tables))
    a = np.rint(rng.standard_normal((dim, tables * projections)) * DIRECTION_STEPS)
    b = np.rint(rng.random(tables * projections) * width * VECTOR_STEPS * DIRECTION_STEPS)
    return a, b


def keys(unit: np.ndarray, salt: np.ndarray, projections: int = PROJECTIONS, tables: int = TABLES, width: float = WIDTH) -> np.ndarray:
    """Bucket keys (rows, tables) of unit vectors: floor((a.x + b) / width) of each table's projections, hashed with
    the table's number and the salt (the label, here)."""
    a, b = directions(unit.shape[1], projections, tables, width)
    cells = np.floor((np.rint(unit * VECTOR_STEPS) @ a + b) / (width * VECTOR_STEPS * DIRECTION_STEPS)).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(unit), tables, projections)
    key = np.arange(1, tables + 1, dtype=np.uint64)[None, :] * U64(0xA0761D6478BD642F) ^ salt[:, None]
    for p in range(projections):
        key = mix(key ^ (cells[:, :, p] * U64(0x9E3779B97F4A7C15)))
    return key


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v: list | None) -> bytes | None:
    """The vector's doubles, if it links with anything at all."""
    if not v or any(c is None for c in v):
        return None
    x = np.array(v, dtype="<f8")
    return x.tobytes() if np.isfinite(x).all() and (x != 0).any() else None


def read_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [usable(v) for v in batch.column(2).to_pylist()]
        labels = batch.column(1).to_pylist()
        nodes = [None if v is None or lab is None else xxhash.xxh3_64_intdigest(v, seed=hash_label(lab)) - 2**63 for v, lab in zip(vecs, labels, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array([None if n is None else hash_label(lab) - 2**63 for n, lab in zip(nodes, labels, strict=True)], pa.int64()), pa.array([v if n is not None else None for v, n in zip(vecs, nodes, strict=True)], pa.binary())], names=["vec_id", "node", "salt", "vec"])


def hash_label(label: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(label).encode())


def by_length(vecs: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(v) for v in vecs])
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def keyed(projections: int, tables: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            salt = batch.column(1).to_numpy().view(np.uint64)
            out = np.zeros((len(vecs), tables), np.uint64)
            for rows in by_length(vecs):
                out[rows] = keys(unit_rows([vecs[i] for i in rows]), salt[rows] ^ U64(len(vecs[rows[0]])), projections, tables, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(out.view(np.int64).ravel(), [tables] * len(vecs))], names=["node", "keys"])

    return run


class Lot:
    """Whole groups of rows (key, i, j, own, node, weight, salt, vec), all of one vector length, as arrays."""

    def __init__(self, cols: dict[str, np.ndarray], unit: np.ndarray, params: tuple[int, int, float]):
        self.c, self.unit, self.params = cols, unit, params
        same = np.ones(len(unit), bool)
        for n in ("key", "i", "j"):
            same[1:] &= cols[n][1:] == cols[n][:-1]
        same[:1] = False
        self.begin = np.flatnonzero(~same)
        self.size = np.diff(np.append(self.begin, len(unit)))

    def close_pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of a group whose cosine reaches the threshold: within its block, or between its two."""
        found = [(np.zeros(0, np.int64),) * 2]
        one = self.c["i"][self.begin] == self.c["j"][self.begin]
        for n in np.unique(self.size[one & (self.size <= SMALL) & (self.size > 1)]):
            at = self.begin[one & (self.size == n)]
            for k in range(0, len(at), max(1, LOT // n)):
                rows = at[k : k + max(1, LOT // n), None] + np.arange(n)
                u = self.unit[rows]
                g, x, y = np.nonzero(np.triu(np.matmul(u, u.transpose(0, 2, 1)) >= threshold - 1e-9, 1))
                found.append((rows[g, x], rows[g, y]))
        for at, n, single in zip(*(v.tolist() for v in (self.begin, self.size, one)), strict=True):
            if single and n <= SMALL:
                continue
            own = self.c["own"][at : at + n]
            left = at + (np.arange(n) if single else np.flatnonzero(own == self.c["i"][at]))
            right = left if single else at + np.flatnonzero(own == self.c["j"][at])
            x, y = np.nonzero(self.unit[left] @ self.unit[right].T >= threshold - 1e-9)
            keep = x < y if single else np.ones(len(x), bool)
            found.append((left[x[keep]], right[y[keep]]))
        p, q = (np.concatenate(v) for v in zip(*found, strict=True))
        exact = [np.einsum("ij,ij->i", self.unit[p[k : k + 20_000]], self.unit[q[k : k + 20_000]]) >= threshold for k in range(0, len(p), 20_000)]
        ok = np.concatenate([np.zeros(0, bool), *exact])
        return p[ok], q[ok]

    def counted_here(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs meet in their group's table first."""
        node, first, inverse = np.unique(self.c["node"], return_index=True, return_inverse=True)
        used = np.unique(np.concatenate([inverse[p], inverse[q]]))
        place = np.zeros(len(node), np.int64)
        place[used] = np.arange(len(used))
        rows = first[used]
        salt = self.c["salt"][rows].view(np.uint64) ^ U64(8 * self.unit.shape[1])
        codes = np.concatenate([keys(self.unit[rows[k : k + 2000]], salt[k : k + 2000], *self.params) for k in range(0, len(rows), 2000)]) if len(rows) else np.zeros((0, 1), np.uint64)
        out = [np.zeros(0, bool)]
        for k in range(0, len(p), 20_000):
            a, b = codes[place[inverse[p[k : k + 20_000]]]], codes[place[inverse[q[k : k + 20_000]]]]
            met = (a == b).argmax(axis=1)
            out.append(a[np.arange(len(a)), met].view(np.int64) == self.c["key"][p[k : k + 20_000]])
        return np.concatenate(out)

    def links(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, other): by node its weighted links in these groups, and the smallest node that they lead to."""
        p, q = self.close_pairs(threshold)
        mine = self.counted_here(p, q)
        p, q = p[mine], q[mine]
        node, at = np.unique(self.c["node"], return_inverse=True)
        weight = self.c["weight"]
        count = np.bincount(at[p], weight[q], len(node)) + np.bincount(at[q], weight[p], len(node))
        p, q, root = at[p], at[q], np.arange(len(node))
        while len(p):
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = count > 0
        return node[some], count[some].astype(np.int64), node[root[some]]


def compared(threshold: float, projections: int, tables: int, width: float):
    """Rows of groups, sorted by them, to (node, links, other), see Lot.links."""
    names = ["key", "i", "j", "own", "node", "weight", "salt"]

    def lots(part: pa.Table) -> Iterator[pa.RecordBatch]:
        vecs = part.column("vec").to_pylist()
        cols = {n: part.column(n).to_numpy() for n in names}
        for rows in by_length(vecs):
            n, c, o = Lot({k: v[rows] for k, v in cols.items()}, unit_rows([vecs[i] for i in rows.tolist()]), (projections, tables, width)).links(threshold)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(o, pa.int64())], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < LOT:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = [whole.column(n).to_numpy() for n in names[:3]]
            last = np.logical_and.reduce([x == x[-1] for x in ids])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0  # the last group may go on
            if cut:
                yield from lots(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            yield from lots(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, tables: int = TABLES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors have the same length, and the cosine in double
    precision is at least `threshold`. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Rows with equal vectors and labels are one node with their number as its weight, so they link with
    each other without being paired. Bucket members meet in blocks of at most `block` nodes; every pair of blocks of a
    large bucket is a task's work of its own. A pair is counted in the first table in which it meets, and only counts
    and a spanning forest leave a block, never the pairs. Rows that share a vec_id are separate vectors; rows
    without one take part, and their component's id is the smallest id there is in it (null if none).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(read_vectors, "vec_id long, node long, salt long, vec binary")
    rows = scratch.keep(rows, "rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("id"), F.first("salt").alias("salt"), F.first("vec").alias("vec"))
    nodes = scratch.keep(nodes, "nodes")
    coded = nodes.select("node", "salt", "vec").mapInArrow(keyed(projections, tables, width), "node long, keys array<long>")
    each = scratch.keep(coded.select("node", F.explode("keys").alias("key")), "keys")
    shared = scratch.keep(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    member = each.join(shared, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("key", "node", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    member = member.join(nodes.select("node", "weight", "salt", "vec"), "node")
    dealt = member.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.keep(dealt.select("key", "i", "j", "own", "node", "weight", "salt", "vec").mapInArrow(compared(threshold, projections, tables, width), "node long, links long, other long"), "found")
    label = components(scratch, found.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b"))
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "weight", "id").join(count, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.keep(named, "named")
    scratch.drop("keys", "shared", "found", "nodes", "cc-labels")  # what follows reads none of them
    smallest = named.groupBy("label").agg(F.min("id").alias("component"))
    per = named.join(smallest, "label").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = rows.select("vec_id", "node").join(per, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
