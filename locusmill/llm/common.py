"""Shared pieces of the text operators: tables, scratch tables in the shared folder, batches, hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill import scratch
from locusmill.session import ship

#: Bytes of text that a Python worker holds as words at a time; longer texts are held alone.
SLICE_BYTES = 1 << 20
#: Entries of a worker's word cache; it is emptied when full, which changes no result.
CACHE_WORDS = 200_000

U64 = np.uint64
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


#: Rows and bytes that go to a Python worker at a time, by the settings that bound them and their defaults: texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(1 << 25))}


def ready(spark: SparkSession) -> None:
    """Ship the package, and bound the batches of the session, unless it has bounds of its own."""
    ship(spark)
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch(scratch.Scratch):
    """Written tables of an operator, with the batch size that its Python workers need."""

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        super().__init__(spark, name)


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that isn't among columns."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name += "_"
    return name


#: Columns that tell rows apart, equal ones too.
ROW_ID = ("row_file_", "row_index_")


def with_row_ids(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df with ROW_ID, from the files that it is read from; what isn't read from Parquet files is written first."""
    from pyspark.errors import AnalysisException

    try:
        df.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        df = scratch.keep(df, "rows")
    return df.select(*df.columns, F.xxhash64("_metadata.file_path").alias(ROW_ID[0]), F.col("_metadata.row_index").alias(ROW_ID[1]))


def text_key(column: str = "text"):
    """16 bytes that identify a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with their texts as bytes (null: empty), of about `most` bytes each."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        t = texts[i].as_py() or b""
        held.append(t)
        size += len(t)
        if size >= most or len(held) >= 5000:
            yield start, i + 1, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, len(texts), held


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none), one after another, and how many each text has; lower: A-Z as a-z."""
    texts = pc.fill_null(texts, "")
    own = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = own.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    at = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    offsets = own.offsets.to_numpy() - own.offsets[0].as_py()
    return flat.filter(some), at[offsets[1:]] - at[offsets[:-1]]


def parts_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


class WordHash(dict):
    """64-bit hashes of words, remembered up to CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHash()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; wraps around."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def room(x: np.ndarray, n: int) -> np.ndarray:
    """x with zeros after it, so that it has n rows at least; twice as many as before at least, if any are added."""
    return x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def lists(values: np.ndarray, lengths: list[int], kind=pa.int64()) -> pa.Array:
    """A list column from its flat values and the rows' lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of links (a, b): rows (node, label), the label being the component's smallest node.

    Links are contracted in rounds until none is left: every node goes to the first of itself and its neighbours, and
    the links are drawn anew between the nodes so reached. In the first two rounds the order is that of the nodes, which
    ends stars, whatever their middle; in each later one it is a new random order, which halves the nodes
    that still have links, or better, on average, whatever their numbers: O(log n) rounds. Then the rounds' steps are
    followed back from the last to the first, each being as large as its round, and the last names are exchanged for
    the smallest nodes. Rounds are written tables, so no plan grows with their number.
    """
    now = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-links0")
    steps: list[DataFrame] = []
    while now.limit(1).count():
        k = len(steps)
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        if k < 2:
            first = F.least("node", F.min("other"))
        else:
            turn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("turn"), F.col(c).alias("node"))  # noqa: B023, E731
            first = F.least(F.struct(F.xxhash64(F.col("node"), F.lit(k)).alias("turn"), "node"), F.min(turn("other")))["node"]
        step = scratch.keep(ends.groupBy("node").agg(first.alias("to")), f"{name}-step{k}")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        now = now.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        now = scratch.keep(now, f"{name}-links{k + 1}")
        scratch.drop(f"{name}-links{k}")
        steps.append(step)
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ways = steps[-1]
    for k in range(len(steps) - 2, -1, -1):
        further = ways.select(F.col("node").alias("to"), F.col("to").alias("then"))
        ways = steps[k].join(further, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
        if k == 0 or k % 4 == 1:
            ways = scratch.keep(ways, f"{name}-ways{k}")
    if len(steps) > 1:
        least = ways.groupBy("to").agg(F.min("node").alias("label"))
        ways = ways.join(least, "to").select("node", "label")
    else:
        ways = ways.select("node", F.col("to").alias("label"))
    out = scratch.keep(ways, f"{name}-labels")
    scratch.drop(f"{name}-links{len(steps)}", *(f"{name}-{kind}{k}" for k in range(len(steps)) for kind in ("step", "ways")))
    return out


def running_total(scratch: Scratch, df: DataFrame, name: str, order: list, value: str, group: str | None = None, out: str = "cum") -> DataFrame:
    """df with the running total of a long column in the given order, within `group` where given (nulls are a group).

    The rows are dealt out by range and kept; each part's totals, as many rows as parts times groups, give the offsets
    at which the parts' own running totals start. No key's rows have to meet in one task.
    """
    from pyspark.sql import Window

    keys = [F.col(group).asc_nulls_last()] if group else []
    dealt = df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    by = ["part_", *([group] if group else [])]
    totals = dealt.groupBy(*by).agg(F.sum(value).alias("t_"))
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before_", F.coalesce(F.sum("t_").over(w), F.lit(0))).drop("t_")
    totals = scratch.keep(totals, f"{name}-offsets")
    own = dealt.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = totals.select(F.col("part_").alias("p_"), F.col("before_"), *([F.col(group).alias("g_")] if group else []))
    cond = F.col("part_") == F.col("p_")
    if group:
        cond = cond & F.col(group).eqNullSafe(F.col("g_"))
    joined = own.join(totals, cond)
    return joined.withColumn(out, F.col(out) + F.col("before_")).drop("part_", "p_", "before_", *(["g_"] if group else []))
