"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import Scratch, running_total, slices

#: Weights that the sources get in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a document may be taken.
EPOCHS = 3


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(t.split()) for _, _, texts in slices(batch) for t in texts]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in keep), "size"])


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources share the total by weight, and a target stops at `epochs` times its source's size, the excess going to the
    others by weight until none is above. In ascending order of size over weight the stopped sources come first, so
    running sums over the sources, which may be many, give the level at which the rest share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per = running_total(scratch, per.withColumn("one", F.lit(1).cast("long")), "named", [by_name], "one", out="nth")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    per = scratch.keep(per.select("source", "source_size", given.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most")), "weighed")
    by_level = [F.col("most") / F.col("weight"), by_name]
    whole, heaviest = (per.agg(F.sum(c)).scalar() for c in ("source_size", "weight"))
    per = running_total(scratch, per, "levels", by_level, "most", out="most_")
    per = running_total(scratch, per, "heavies", by_level, "weight", out="weight_")
    left, heavy = whole - F.col("most_") + F.col("most"), heaviest - F.col("weight_") + F.col("weight")
    per = scratch.keep(per.withColumn("stopped", F.col("most") * heavy < left * F.col("weight")), "stopped")
    stopped = per.where("stopped").agg(F.coalesce(F.sum("most"), F.lit(0))).scalar()
    per = per.withColumns({"rest": whole - stopped, "open": per.where("not stopped").agg(F.sum("weight")).scalar()})
    share = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("open").cast("double"))
    return per.select("source", "source_size", share.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs (doc_id, text, source) with size, source_size, target and taken (words the mix takes).

    Documents of a source queue in the order of md5(doc_id), pass after pass; a document's virtual finish time is its
    source's tokens up to and with it, divided by the target. All queues are merged by range-sorting on that time, and
    the merged queue is cut where its running total passes the budget (the sum of all sizes). A source's share thus
    differs from its target by less than two of its documents. Only pieces that start before virtual time 1 can be taken.

    Null texts and texts without words have size 0 and are not taken; a null source is a source of its own, the last;
    rows that are equal in all columns are separate documents. Columns named in `carry` come along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    read = [c for c in dict.fromkeys(["doc_id", "source", *carry]) if c != "text"]
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in read)
    sizes = docs.select(*read, "text").mapInArrow(word_counts, f"{kind}, size long")
    sizes = sizes.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = scratch.keep(sizes, "counted")  # range-sorting reads its input twice
    order = [F.col("turn"), F.col("size"), F.col("doc_id")]
    queued = scratch.keep(running_total(scratch, sizes, "sizes", order, "size", group="source"), "queued")
    targets = scratch.keep(source_targets(scratch, queued, weights, epochs), "targets")
    t = targets.select(F.col("source").alias("s_"), "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    each = queued.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(epochs)])))
    each = each.withColumn("start", F.col("pass") * F.col("source_size") + F.col("cum") - F.col("size"))
    each = each.where((F.col("size") > 0) & (F.col("start") < F.col("target")))
    each = each.select("doc_id", "source", "turn", "size", "pass", ((F.col("start") + F.col("size")) / F.col("target")).alias("finish"), F.col("cum").alias("place"))
    merged = running_total(scratch, each, "merged", [F.col("finish"), F.col("source").asc_nulls_last(), F.col("place"), F.col("pass")], "size", out="sent")
    budget = targets.agg(F.sum("source_size")).scalar()
    taken = merged.withColumn("budget", budget).where(F.col("sent") <= F.col("budget"))
    taken = taken.groupBy(F.col("source").alias("s_"), F.col("place").alias("p_")).agg(F.sum("size").alias("taken"))
    out = queued.join(taken, F.col("source").eqNullSafe(F.col("s_")) & (F.col("cum") == F.col("p_")) & (F.col("size") > 0), "left")
    return out.select(*read, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

