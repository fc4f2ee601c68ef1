"""Bayesian mixture model of ambiguous rows, fitted by expectation-maximisation for one or many pools."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.operators.dealing import deal, parts
from locusmill.scratch import Scratch

#: Pools up to this number are fitted together, pass by pass over the data; more are fitted each within a task.
FEW_POOLS = 64
#: Rows of a pool above which it is fitted pass by pass even among many pools.
LARGE_POOL = 200_000
#: Rows whose pools a task fits together, and rows of parameters that it gives at a time.
TOGETHER, GIVEN = 20_000, 200_000


@dataclass(frozen=True)
class Options:
    features: int
    pi_prior: float = 0.0
    theta_prior: float = 200_000.0
    epsilon: float = 1e-7
    max_iter: int = 100
    use_likelihood: bool = False
    #: Of many pools, give parameters of features with data only, and one row for all others.
    sparse: bool = False


@dataclass
class Csr:
    """Rows of a pool: features fid and log weights lq by row from ptr, each row standing for `many` equal ones."""

    fid: np.ndarray
    lq: np.ndarray
    ptr: np.ndarray
    many: np.ndarray

    def __post_init__(self) -> None:
        self.size = np.diff(np.append(self.ptr, len(self.fid)))
        self.row = np.repeat(np.arange(len(self.ptr)), self.size)
        self.amb = self.size > 1
        self.w = np.exp(np.maximum.reduceat(self.lq, self.ptr)) if len(self.ptr) else np.zeros(0)

    def log_joint(self, pi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            lp, lt = np.log(pi), np.log(theta)
        return self.lq + lp[self.fid] + np.where(self.amb[self.row], lt[self.fid], 0.0)

    def expect(self, pi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Posteriors; rows without any possible feature are 0."""
        x = self.log_joint(pi, theta)
        top = np.maximum.reduceat(x, self.ptr)
        e = np.exp(x - np.where(np.isfinite(top), top, 0.0)[self.row])
        s = np.add.reduceat(e, self.ptr)
        return e / np.where(s > 0, s, 1.0)[self.row]

    def sums(self, z: np.ndarray, k: int) -> np.ndarray:
        """Weighted posterior mass of ambiguous rows by feature."""
        return np.bincount(self.fid, z * (self.w * self.many * self.amb)[self.row], k)

    def likelihood(self, z: np.ndarray, pi: np.ndarray, theta: np.ndarray) -> float:
        x = self.log_joint(pi, theta)
        return float((np.where(z > 0, z * np.where(np.isfinite(x), x, 0.0), 0.0) * self.many[self.row]).sum())


@dataclass
class Totals:
    """What the M-step needs of a pool besides the posteriors."""

    all_w: float
    amb_w: float
    max_w: float
    unique: np.ndarray

    @classmethod
    def of(cls, c: Csr, k: int) -> Totals:
        w = c.w * c.many
        return cls(float(w.sum()), float(w[c.amb].sum()), float(c.w.max(initial=0.0)), np.bincount(c.fid, np.exp(c.lq) * (c.many * ~c.amb)[c.row], k))

    def maximise(self, t: np.ndarray, o: Options, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pp, tp, k = o.pi_prior * self.max_w, o.theta_prior * self.max_w, o.features
        down = self.amb_w + tp * k
        return (self.unique + t + pp) / (self.all_w + pp * k), (t + tp) / down if down > 0 else theta


def signatures(scores: DataFrame) -> DataFrame:
    """Rows of scores (pool, rid, fid, raw) with equal cells as one: pool, fids, raws, many.

    Equal rows have equal posteriors and weights, so the fit is the same with one row and its number.
    """
    rows = deal(scores.where("pool IS NOT NULL"), "rid").groupBy("pool", "rid").agg(F.array_sort(F.collect_list(F.struct("fid", "raw"))).alias("cells"))
    sig = rows.groupBy("pool", "cells").agg(F.count(F.lit(1)).alias("many"))
    return sig.select("pool", F.col("cells.fid").alias("fids"), F.col("cells.raw").alias("raws"), "many")


def csr(fids: list, raws: list, many: np.ndarray, most: float) -> Csr:
    sizes = np.array([len(f) for f in fids], dtype=np.int64)
    t = 100.0 * np.concatenate([np.asarray(r, dtype=np.float64) for r in raws]) / most
    with np.errstate(divide="ignore"):
        lq = t + np.log1p(-np.exp(-t))
    return Csr(np.concatenate([np.asarray(f, dtype=np.int64) for f in fids]), lq, np.cumsum(sizes) - sizes, np.asarray(many, dtype=np.float64))


def by_pool(batch: pd.DataFrame) -> Iterator[tuple[object, Csr]]:
    for pool, part in batch.groupby("pool", sort=True):
        yield pool, csr(part["fids"].tolist(), part["raws"].tolist(), part["many"].to_numpy(), float(part["most"].iloc[0]))


def fit_passes(spark: SparkSession, sig: DataFrame, o: Options) -> dict[str, dict]:
    """Fits of few pools, all data passed over once an iteration: tasks give sums by pool and feature, the driver the M-step.

    What reaches the driver and goes back is pools times features numbers, whatever the number of rows.
    """
    k = o.features
    state: dict[str, dict] = {}

    def collect(params: dict[str, tuple] | None, likelihood: bool) -> dict[str, np.ndarray]:
        sent = spark.sparkContext.broadcast(params)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[str, np.ndarray] = {}
            for df in batches:
                for pool, c in by_pool(df):
                    if sent.value is None:
                        t = Totals.of(c, k)
                        new = np.concatenate([[t.all_w, t.amb_w, t.max_w], t.unique])
                        old = acc.get(pool)
                        acc[pool] = new if old is None else np.concatenate([old[:2] + new[:2], np.maximum(old[2:3], new[2:3]), old[3:] + new[3:]])
                    elif likelihood:
                        before, after = sent.value[pool]
                        acc[pool] = acc.get(pool, 0.0) + np.array([c.likelihood(c.expect(*before), *after)])
                    else:
                        acc[pool] = acc.get(pool, 0.0) + c.sums(c.expect(*sent.value[pool]), k)
            for pool, v in acc.items():
                yield pd.DataFrame({"pool": [pool] * len(v), "at": np.arange(len(v)), "v": v})

        rows = sig.mapInPandas(part, "pool string, at int, v double")
        value = F.when((F.lit(params is None)) & (F.col("at") == 2), F.max("v")).otherwise(F.sum("v"))
        got = rows.groupBy("pool", "at").agg(value.alias("v")).toArrow().to_pandas()
        sent.unpersist()
        return {p: x.sort_values("at")["v"].to_numpy() for p, x in got.groupby("pool")}

    for pool, v in collect(None, False).items():
        even = np.full(k, 1.0 / k)
        state[pool] = {"totals": Totals(v[0], v[1], v[2], v[3:]), "now": (even, even), "before": (even, even), "n": 0, "done": o.max_iter == 0, "lnl": np.inf}
    while open_ := {p: s for p, s in state.items() if not s["done"]}:
        sums = collect({p: s["now"] for p, s in state.items()}, False)
        for p, s in open_.items():
            s["before"], s["n"] = s["now"], s["n"] + 1
            s["now"] = s["totals"].maximise(sums[p], o, s["now"][1])
        if o.use_likelihood:
            for p, v in collect({p: (s["before"], s["now"]) for p, s in state.items()}, True).items():
                if p in open_:
                    state[p]["done"], state[p]["lnl"] = abs(v[0] - state[p]["lnl"]) < o.epsilon, v[0]
        for s in open_.values():
            s["done"] = s["done"] or s["n"] >= o.max_iter or (not o.use_likelihood and np.abs(s["now"][0] - s["before"][0]).sum() < o.epsilon)
    for p, v in collect({p: (s["before"], s["now"]) for p, s in state.items()}, True).items():
        state[p]["lnl"] = float(v[0])
    return state


PARAMS = "pool string, fid long, pi_before double, theta_before double, pi double, theta double, iterations int, lnl double"


def param_rows(pool: str, before: tuple, after: tuple, n: int, lnl: float) -> pd.DataFrame:
    """A row a feature."""
    k = len(after[0])
    return pd.DataFrame({"pool": [pool] * k, "fid": np.arange(k), "pi_before": before[0], "theta_before": before[1], "pi": after[0], "theta": after[1], "iterations": [n] * k, "lnl": [lnl] * k})


class Pools:
    """Whole pools fitted side by side: their rows are one Csr, whose columns are the pairs of a pool and a feature it has.

    A pool's other features have equal parameters; its last column, which no row has, stands for `alike` of them.
    """

    def __init__(self, at: np.ndarray, fid: np.ndarray, lq: np.ndarray, size: np.ndarray, many: np.ndarray, o: Options):
        """Rows in order of their pools `at` (0, 1, ...), cells fid and lq by row, of `size` cells each."""
        self.o, self.at, self.pools = o, at, int(at[-1]) + 1
        pair = np.repeat(at, size) * (o.features + 1) + fid
        last = np.arange(1, self.pools + 1) * (o.features + 1) - 1
        pairs, place = np.unique(np.concatenate([pair, last]), return_inverse=True)
        self.pool, self.fid = np.divmod(pairs, o.features + 1)
        self.c = Csr(place[: len(pair)], lq, np.cumsum(size) - size, many)
        self.other = self.fid == o.features
        self.alike = np.where(self.other, (o.features + 1 - np.bincount(self.pool))[self.pool], 1)
        self.cell_pool = np.repeat(at, size)
        first, w = np.searchsorted(at, np.arange(self.pools)), self.c.w * self.c.many
        max_w = np.maximum.reduceat(self.c.w, first)
        self.unique = np.bincount(self.c.fid, np.exp(self.c.lq) * (self.c.many * ~self.c.amb)[self.c.row], len(pairs))
        self.pp, self.tp = (o.pi_prior * max_w)[self.pool], (o.theta_prior * max_w)[self.pool]
        self.all = np.bincount(at, w, self.pools)[self.pool] + self.pp * o.features
        self.down = np.bincount(at, w * self.c.amb, self.pools)[self.pool] + self.tp * o.features

    def step(self, pi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.c.sums(self.c.expect(pi, theta), len(pi))
        return (self.unique + t + self.pp) / self.all, np.where(self.down > 0, (t + self.tp) / np.where(self.down > 0, self.down, 1.0), theta)

    def likelihood(self, before: tuple, after: tuple) -> np.ndarray:
        z, x = self.c.expect(*before), self.c.log_joint(*after)
        return np.bincount(self.cell_pool, np.where(z > 0, z * np.where(np.isfinite(x), x, 0.0), 0.0) * self.c.many[self.c.row], self.pools)

    def of(self, keep: np.ndarray) -> Pools:
        """The pools that `keep` marks, and no others."""
        rows, cells = keep[self.at], keep[self.cell_pool]
        return Pools((np.cumsum(keep) - 1)[self.at[rows]], self.fid[self.c.fid[cells]], self.c.lq[cells], self.c.size[rows], self.c.many[rows], self.o)

    def fit(self) -> tuple[tuple, tuple, np.ndarray, np.ndarray]:
        """Parameters by pair before the last step and after it, iterations and log likelihood by pool.

        Each pool ends by itself. Those that have ended are left out of the steps once they are half of all.
        """
        even = np.full(len(self.pool), 1.0 / self.o.features)
        now, before = [even.copy(), even.copy()], [even.copy(), even.copy()]
        n, lnl = np.zeros(self.pools, dtype=np.int32), np.full(self.pools, np.inf)
        left, ids = self, np.arange(self.pools)  # the pools that still step
        going = np.full(self.pools, self.o.max_iter > 0)
        while going[ids].any():
            if going[ids].sum() * 2 < len(ids):
                left, ids = left.of(going[ids]), ids[going[ids]]
            here = np.flatnonzero(np.isin(self.pool, ids))
            old = (now[0][here], now[1][here])
            new = left.step(*old)
            moving = going[ids][left.pool]
            for held, was, to in zip((before[0], before[1], now[0], now[1]), (before[0][here], before[1][here], *old), (*old, *new), strict=True):
                held[here] = np.where(moving, to, was)
            n[ids[going[ids]]] += 1
            if self.o.use_likelihood:
                value = left.likelihood(old, new)
                small = np.abs(value - lnl[ids]) < self.o.epsilon
                lnl[ids] = value
            else:
                small = np.bincount(left.pool, np.abs(new[0] - old[0]) * left.alike, len(ids)) < self.o.epsilon
            going[ids] &= ~small & (n[ids] < self.o.max_iter)
        return tuple(before), tuple(now), n, self.likelihood(tuple(before), tuple(now))


def fit_together(rows: pa.Table, o: Options) -> Iterator[pa.RecordBatch]:
    """Rows of whole pools (pool, fids, raws, many), a pool's together, to PARAMS: a row a feature, or, if sparse, only
    for those the pool has, and one, of feature -1, for all others."""
    pool, fids = rows["pool"].combine_chunks(), rows["fids"].combine_chunks()
    fresh = np.append(True, pc.not_equal(pool.slice(1), pool.slice(0, len(pool) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
    at, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    size = pc.list_value_length(fids).to_numpy().astype(np.int64)
    raw = rows["raws"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    cells = np.cumsum(size) - size
    most = np.maximum.reduceat(raw, cells[first])
    x = 100.0 * raw / most[np.repeat(at, size)]
    with np.errstate(divide="ignore"):
        lq = x + np.log1p(-np.exp(-x))
    p = Pools(at, fids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lq, size, rows["many"].to_numpy().astype(np.float64), o)
    before, after, n, lnl = p.fit()
    names, values = pool.take(pa.array(first)), np.stack([*before, *after])
    ends = np.append(np.flatnonzero(p.other), len(p.pool))
    some = max(1, GIVEN // o.features)
    for low in range(0, p.pools, some):
        high = min(low + some, p.pools)
        here = slice(ends[low - 1] + 1 if low else 0, ends[high - 1] + 1)
        if o.sparse:
            here = np.arange(here.start, here.stop)[p.alike[here] > 0]
            of, v, fid = p.pool[here], values[:, here], np.where(p.other[here], -1, p.fid[here])
        else:
            of, fid = np.repeat(np.arange(low, high), o.features), np.tile(np.arange(o.features), high - low)
            v = np.repeat(values[:, ends[low:high]], o.features, axis=1)
            own = np.arange(here.start, here.stop)[~p.other[here]]
            v[:, (p.pool[own] - low) * o.features + p.fid[own]] = values[:, own]
        columns = [names.take(pa.array(of)), pa.array(fid.astype(np.int64)), *[pa.array(c) for c in v], pa.array(n[of]), pa.array(lnl[of])]
        yield pa.RecordBatch.from_arrays(columns, names=["pool", "fid", "pi_before", "theta_before", "pi", "theta", "iterations", "lnl"])


def fit_each(o: Options):
    """Rows of sig sorted by pool to PARAMS, some pools together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TOGETHER:
                rows = pa.Table.from_batches(held).combine_chunks()
                start = pc.index(rows["pool"], rows["pool"][-1]).as_py()  # of the last pool, which may go on
                if start:
                    yield from fit_together(rows.slice(0, start), o)
                    held = rows.slice(start).combine_chunks().to_batches()
        if any(x.num_rows for x in held):
            yield from fit_together(pa.Table.from_batches(held), o)

    return run


def fit(scores: DataFrame, o: Options, scratch: Scratch | None = None) -> DataFrame:
    """PARAMS of every pool of scores (pool string, rid, fid, raw): parameters before and after the last step.

    Few pools are fitted pass by pass over rows that stay where they are; of many pools the small ones are fitted each
    in a task, the large ones as if they were few. No rows give no parameters.
    """
    spark = scores.sparkSession
    scratch = scratch or Scratch(spark, "em")
    sig = scratch.keep(signatures(scores), "signatures")
    sizes = scratch.keep(sig.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_max("raws")).alias("most")), "pools")
    few = sizes.limit(FEW_POOLS + 1).count() <= FEW_POOLS
    big = sizes if few else sizes.where(F.col("rows") > LARGE_POOL)
    some = few or big.limit(1).count() > 0
    fitted = fit_passes(spark, sig.join(big.select("pool", "most"), "pool"), o) if some else {}
    frames = [param_rows(p, s["before"], s["now"], s["n"], s["lnl"]) for p, s in fitted.items()]
    out = spark.createDataFrame(pa.Table.from_pandas(pd.concat(frames), preserve_index=False)).selectExpr("pool", "fid", "pi_before", "theta_before", "pi", "theta", "CAST(iterations AS INT) iterations", "lnl") if frames else spark.createDataFrame([], PARAMS)
    if few:
        return out
    small = deal(sig.join(big.select("pool"), "pool", "left_anti") if some else sig, "pool", n=parts(scores)).sortWithinPartitions("pool")
    return out.unionByName(small.mapInArrow(fit_each(o), PARAMS))


def posteriors(scores: DataFrame, params: DataFrame) -> DataFrame:
    """z (pool, rid, fid, raw, z) of every cell, from the parameters before the last step."""
    lq = with_lq(scores)
    lp = params.select("pool", "fid", F.when(F.col("pi_before") > 0, F.ln("pi_before")).alias("lp"), F.when(F.col("theta_before") > 0, F.ln("theta_before")).alias("lt"))
    row = Window.partitionBy("pool", "rid")
    x = F.col("lq") + F.col("lp") + F.when(F.col("nnz") > 1, F.col("lt")).otherwise(0.0)
    joined = lq.withColumn("nnz", F.count(F.lit(1)).over(row)).join(lp, ["pool", "fid"]).withColumn("x", x)
    e = joined.withColumn("e", F.coalesce(F.exp(F.col("x") - F.max("x").over(row)), F.lit(0.0)))
    return e.select("pool", "rid", "fid", "raw", F.coalesce(F.try_divide(F.col("e"), F.sum("e").over(row)), F.lit(0.0)).alias("z"))


def with_lq(scores: DataFrame) -> DataFrame:
    """lq of every cell, scaled by its pool's largest score."""
    most = scores.groupBy("pool").agg(F.max("raw").alias("most"))
    t = scores.join(most, "pool").withColumn("t", F.lit(100.0) * F.col("raw") / F.col("most"))
    return t.withColumn("lq", F.col("t") + F.log1p(-F.exp(-F.col("t")))).drop("t", "most")


def model_selection(scores: DataFrame, params: DataFrame) -> DataFrame:
    """One row over all pools: log likelihood, rows with data, parameters, AIC and BIC."""
    per = params.groupBy("pool").agg(F.first("lnl").alias("lnl"))
    seen = scores.groupBy("pool").agg(F.countDistinct("rid").alias("obs"), (2 * F.countDistinct("fid")).alias("params"))
    all_ = per.join(seen, "pool").agg(F.sum("lnl").alias("lnl"), F.sum("obs").alias("obs"), F.sum("params").alias("params"))
    return all_.select("lnl", "obs", "params", (2.0 * F.col("params") - 2.0 * F.col("lnl")).alias("aic"), (F.col("params") * F.ln("obs") - 2.0 * F.col("lnl")).alias("bic"))
