"""Exact substring deduplication by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import U64, Scratch, fresh, hashes, lists, mix, slices, text_key

#: Words of a window, and of the windows that the first level counts.
WINDOW, FIRST = 35, 8


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Lengths of the levels: first, twice that and so on, then the window itself."""
    out = [min(first, window)]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return out + [window] * (out[-1] < window)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of the two windows that cover it."""
    return mix(left * U64(0x9E3779B97F4A7C15) + (right ^ U64(0x632BE59BD9B4E019)))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of `length` words, built by doubling from the hashes of single words."""
    h, n = words, 1
    while n < length:
        step = min(n, length - n)
        h = joined(h[: len(h) - step], h[step:])
        n += step
    return h


def smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of each `span` consecutive values, the first among equals."""
    val, pos, n = h, np.arange(len(h)), 1
    while n < span:
        step = min(n, span - n)
        a, b = val[: len(val) - step], val[step:]
        take = b < a
        val, pos, n = np.where(take, b, a), np.where(take, pos[step:], pos[: len(pos) - step]), n + step
    return pos


def representatives(words: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `length`, and for each window of `window` words the position of its representative.

    A window is represented by the smallest-hashed of the shorter windows in it, so equal windows have equal
    representatives, and a window whose representative occurs once cannot itself repeat.
    """
    h = window_hashes(words, length)
    return h, smallest(h, window - length + 1)


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among sorted values."""
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x


def alive_starts(words: np.ndarray, length: int, window: int, repeated: np.ndarray) -> np.ndarray:
    """For each window of `window` words, whether its representative at `length` is among the sorted repeated hashes."""
    if len(words) < window:
        return np.zeros(0, dtype=bool)
    h, rep = representatives(words, length, window)
    return among(h[rep], repeated)


def second_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Other hashes of the windows of `window` words. With the first they make 128 bits, by which the last level counts."""
    return window_hashes(mix(words ^ U64(0x94D049BB133111EB)), window)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at a true start."""
    d = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(d, at, 1)
    np.add.at(d, at + window, -1)
    return np.cumsum(d[:n]) > 0


def first_level(window: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch):
                n_words, shas, flat, lens = [], [], [], []
                for t in texts:
                    words = t.split()
                    n_words.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) >= window:
                        h, rep = representatives(hashes(words), first, window)
                        flat.append(h[np.unique(rep)])
                        lens.append(len(flat[-1]))
                    else:
                        lens.append(0)
                values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), lists(values.view(np.int64), lens)], names=["tkey", "doc_id", "n_words", "sha", "hs"])

    return run


def next_level(length: int, after: int, window: int):
    """From texts with their repeated hashes at `length` to the texts' representatives at `after` for the windows left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch):
                part = batch.slice(lo, hi - lo)
                known = part.column(2)
                keys, flat, lens, kept, more = [], [], [], [], []
                for i, t in enumerate(texts):
                    words = hashes(t.split())
                    alive = alive_starts(words, length, window, np.sort(known[i].values.to_numpy().view(np.uint64)))
                    if alive.any():
                        h, rep = representatives(words, after, window)
                        at = np.unique(rep[alive])
                        flat.append(h[at])
                        more.append(second_hashes(words, window)[at] if after == window else h[:0])
                        lens.append(len(at))
                        keys.append(part.column(0)[i].as_py())
                        kept.append(t)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kept, pa.binary()).cast(pa.string()), lists(np.concatenate(flat).view(np.int64), lens), lists(np.concatenate(more).view(np.int64), lens if after == window else [0] * len(lens))], names=["tkey", "text", "hs", "gs"])

    return run


def cut_texts(window: int, doubled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch):
                part = batch.slice(lo, hi - lo)
                cols: list[list] = [[], [], [], []]
                for i, t in enumerate(texts):
                    words = t.split()
                    own = hashes(words)
                    alive = alive_starts(own, window, window, np.sort(part.column(2)[i].values.to_numpy().view(np.uint64)))
                    if doubled:
                        alive &= among(second_hashes(own, window), np.sort(part.column(3)[i].values.to_numpy().view(np.uint64)))
                    if not alive.any():
                        continue
                    gone = covered(alive, len(words), window)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    for c, v in zip(cols, (part.column(0)[i].as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string())], names=["tkey", "n_removed", "sha", "kept"])

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(texts, cut): digests of every row of docs, and for each distinct text that loses some but not all copies its remains.

    texts: tkey, doc_id, n_words, sha (of all words), copies. cut: tkey, n_removed, sha, kept.
    A text of at least `window` words that occurs twice goes wholly; one of its rows still stands in the levels, so that
    its windows count for others. At each level the representatives of the windows left are counted over all texts, and
    only windows whose representative repeats go on to twice the length. The last level counts windows by 128 bits.
    """
    spark = docs.sparkSession
    src = docs.select(text_key().alias("tkey"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    steps = levels(window, first)
    rows = scratch.keep(src.mapInArrow(first_level(window, steps[0]), "tkey binary, doc_id long, n_words long, sha string, hs array<long>"), "rows")
    reps = rows.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("hs").alias("hs"))
    reps = scratch.keep(reps, "reps")
    left: DataFrame | None = None  # distinct texts with windows left
    hs = reps
    for k, length in enumerate(steps):
        doubled = k > 0 and length == window
        by = ["h", "g"] if doubled else ["h"]
        each = hs.select("tkey", F.explode(F.arrays_zip("hs", "gs")).alias("x")).select("tkey", F.col("x.hs").alias("h"), F.col("x.gs").alias("g")) if doubled else hs.select("tkey", F.explode("hs").alias("h"))
        again = scratch.keep(each.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by), f"again-{length}")
        held = [F.collect_list("h").alias("hs"), *([F.collect_list("g").alias("gs")] if doubled else [])]
        known = each.join(again, by).groupBy("tkey").agg(*held)
        known = scratch.keep(known, f"known-{length}")
        if left is None:
            one = known.join(reps.select("tkey", "rep"), "tkey").withColumnRenamed("tkey", "k_")
            texts = src.join(one, (F.col("tkey") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tkey", "text", "hs")
        else:
            texts = left.join(known, "tkey").select("tkey", "text", "hs", *(["gs"] if doubled else []))
        if length == window:
            cut = scratch.keep(texts.mapInArrow(cut_texts(window, doubled), "tkey binary, n_removed long, sha string, kept string"), "cut")
            break
        found = texts.mapInArrow(next_level(length, steps[k + 1], window), "tkey binary, text string, hs array<long>, gs array<long>")
        hs = scratch.keep(found, f"left-{steps[k + 1]}")
        left = hs.select("tkey", "text")
        scratch.drop(f"again-{length}")
    scratch.drop(*(f"{kind}-{length}" for length in steps for kind in ("again", "known", "left")))  # what follows reads none of them
    all_rows = rows.drop("hs").join(reps.select("tkey", "copies"), "tkey")
    return all_rows, cut


def dedup_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, see remove_repeats."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows, cut = repeated_windows(docs, scratch, window)
    part = cut.select(F.col("tkey").alias("k_"), "n_removed", F.col("sha").alias("cut_sha"))
    out = rows.join(part, (F.col("tkey") == F.col("k_")) & (F.col("copies") == 1), "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    sha = F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha"))
    gone = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    return out.select("doc_id", "n_words", gone.alias("n_removed"), sha.alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with each word removed that lies in a window of `window` words which also starts anywhere else.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Windows are
    judged on the input. Texts that lose words become the kept words joined by one space (n_chars, where there, their
    new code points); others stay as they are. Null texts have no words and stay null; texts shorter than a window
    stay; rows with equal texts of a window or more lose all words. Other columns are kept.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows, cut = repeated_windows(docs, scratch, window)
    whole = rows.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select(F.col("tkey").alias("k_"), F.lit("").alias("kept_")).dropDuplicates(["k_"])
    part = cut.join(whole, F.col("tkey") == F.col("k_"), "left_anti").select(F.col("tkey").alias("k_"), F.col("kept").alias("kept_"))
    changed = scratch.keep(part.unionByName(whole), "changed")
    key, other, kept = (fresh(docs.columns, n) for n in ("tkey_", "other_", "kept_"))
    changed = changed.withColumnsRenamed({"k_": other, "kept_": kept})
    out = docs.withColumn(key, text_key()).join(changed, F.col(key) == F.col(other), "left")
    out = out.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
