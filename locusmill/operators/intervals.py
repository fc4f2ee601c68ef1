"""Intervals: merging, coverage, sub-regions and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of the bins by which overlapping intervals meet; an interval is dealt to those of the least width that is not
#: below its length, so to two bins at most (but for intervals beyond the largest).
WIDTHS = (1 << 7, 1 << 12, 1 << 17, 1 << 22, 1 << 27)


def merge_intervals(iv: DataFrame, by: list[str], start: str = "iv_start", end: str = "iv_end", distance: int = 1) -> DataFrame:
    """Half-open intervals of each group, merged where the next begins no more than `distance` past the end so far."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = iv.withColumn("fresh", F.when(F.col(start) - reach <= distance, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def merged_array(blocks: Column, distance: int = 1) -> Column:
    """An array of (start, end) structs, sorted and merged as in merge_intervals."""

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b["end"]).alias("end")))
        return F.when(b["start"] - last["end"] <= distance, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), grown)).otherwise(F.concat(done, F.array(b)))

    ordered = F.array_sort(blocks)
    return F.when(F.size(ordered) > 0, F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), step)).otherwise(ordered)


def total_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + (b["end"] - b["start"]))


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def hull(a_start: Column, a_end: Column, b_start: Column, b_end: Column, distance: int = 0) -> Column:
    """The interval that holds both of two that overlap or lie `distance` apart at most; null for others."""
    near = F.greatest(a_start, b_start) - F.least(a_end, b_end) <= distance
    return F.when(near, F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end")))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re_: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Pairs of left and right rows with equal keys whose half-open intervals overlap.

    Right intervals are dealt to the bins that they touch in the level of their length; left ones to the bins that they
    touch in the levels down to which right intervals can be longer than a bin, which are few for short ones. Rows meet
    by an equality join on keys, level and bin; of the bins that a pair shares only the first counts. An interval of
    100 million bases is in two bins, and asks for no more bins of a level than right intervals of that level are worth.
    """
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(w).cast("long").alias("width")) for i, w in enumerate(widths)])

    def in_bins(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(start) / F.col("lv.width")), F.floor((F.col(end) - 1) / F.col("lv.width"))
        return df.withColumn("bin", F.explode(F.sequence(first, last))).withColumn(name, first).withColumn("level", F.col("lv.level")).drop("lv")

    size = F.col(re_) - F.col(rs)
    own = F.coalesce(F.element_at(F.filter(levels, lambda x: x["width"] >= size), 1), F.element_at(levels, -1))
    b = right.where(F.col(re_) > F.col(rs)).withColumn("lv", own)
    used = b.agg(F.collect_set("lv.level")).scalar()  # of a handful of levels those that occur
    asked = F.array(*[F.when(F.array_contains(used, i), F.element_at(levels, i + 1)) for i in range(len(widths))])
    a = left.where(F.col(le) > F.col(ls)).withColumn("lv", F.explode(asked)).where("lv is not null")
    a, b = in_bins(a, ls, le, "first_l"), in_bins(b, rs, re_, "first_r")
    pairs = a.join(b, [*keys, "level", "bin"]).where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("bin") == F.greatest("first_l", "first_r")))
    return pairs.drop("bin", "level", "first_l", "first_r")


def block_overlaps(blocks: DataFrame, intervals: DataFrame, by: list[str], keys: list[str], wider: int = 1) -> DataFrame:
    """Overlap of each alignment (columns `by`) with each locus, summed over its blocks and the locus' intervals.

    A block (b_start, b_end) asks for [b_start, b_end + wider), by default one base more than it covers, so bookended
    intervals count as touched; wider 0 gives the plain step lengths.
    """
    asked = blocks.withColumn("q_end", F.col("b_end") + wider)
    pairs = range_join(asked, intervals, keys, "b_start", "q_end", "iv_start", "iv_end")
    length = F.least("iv_end", "q_end") - F.greatest("iv_start", "b_start")
    return pairs.groupBy(*by, "locus").agg(F.sum(length).alias("overlap"))


def assign_locus(overlaps: DataFrame, lengths: DataFrame, by: list[str], threshold: float = 0.2, no_feature: str = "__no_feature") -> DataFrame:
    """The locus of largest overlap (ties: smallest name) of each alignment, where it is more than threshold * alnlen."""
    name = overlaps.groupBy(*by).agg(F.min(F.struct((-F.col("overlap")).alias("o"), "locus")).alias("m")).select(*by, F.col("m.locus").alias("best"), (-F.col("m.o")).alias("overlap"))
    enough = F.col("overlap") > F.col("alnlen") * threshold
    return lengths.join(name, by, "left").select(*by, F.when(enough, F.col("best")).otherwise(no_feature).alias("locus"), F.when(enough, F.col("overlap")).otherwise(0).alias("overlap"))


def feature_length(merged: DataFrame) -> DataFrame:
    """Bases of each locus: the sum of end - start - 1 over its merged half-open intervals."""
    return merged.groupBy("locus").agg(F.sum(F.col("iv_end") - F.col("iv_start") - 1).alias("length"))


def annotation_stats(merged: DataFrame, by: list[str]) -> DataFrame:
    """Loci, intervals, references and the length of the union of all intervals."""
    union = merge_intervals(merged, by, distance=0).agg(F.sum(F.col("iv_end") - F.col("iv_start")).alias("n"))
    refs = merged.select(*by).distinct().agg(F.count(F.lit(1)).alias("n"))
    return merged.agg(F.countDistinct("locus").alias("num_loci"), F.count(F.lit(1)).alias("num_intervals")).select("num_loci", "num_intervals", refs.scalar().alias("num_refs"), union.scalar().alias("union_length"))


def subregion(iv: DataFrame, chrom, start: int, end: int) -> DataFrame:
    """Intervals of one reference, cut to [start, end)."""
    cut = iv.where(F.col("chrom") == chrom).withColumns({"iv_start": F.greatest("iv_start", F.lit(start)), "iv_end": F.least("iv_end", F.lit(end))})
    return cut.where("iv_start < iv_end")


def windows(refs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Fixed windows over references (ref, length), widened by `overlap` on both sides."""
    at = refs.where("length > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return at.select("ref", F.greatest(F.lit(0), F.col("i") - overlap).cast("long").alias("w_start"), F.least(F.col("i") + size + overlap, F.col("length")).cast("long").alias("w_end"))


def point_lookup(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, pos) with the locus, smallest name first, of an interval that holds them; null outside of all."""
    asked = points.select(*keys, "pos").distinct().withColumn("p_end", F.col("pos") + 1)
    hit = range_join(asked, intervals, keys, "pos", "p_end", "iv_start", "iv_end")
    found = hit.groupBy(*keys, "pos").agg(F.min_by(F.struct("locus", "iv_start", "iv_end"), "locus").alias("h"))
    return points.join(found, [*keys, "pos"], "left").withColumns({"locus": F.col("h.locus"), "iv_start": F.col("h.iv_start"), "iv_end": F.col("h.iv_end")}).drop("h")


def two_end_lookup(spans: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, b_start, b_end) with the locus at their two ends; where these differ, that which reaches further in.

    Intervals that lie wholly inside a span are not looked for; on a tie the left one stays.
    """
    left = point_lookup(spans.withColumn("pos", F.col("b_start")), intervals, keys).drop("pos", "iv_start").withColumnsRenamed({"locus": "l_locus", "iv_end": "l_end"})
    both = point_lookup(left.withColumn("pos", F.col("b_end") - 1), intervals, keys).drop("pos", "iv_end").withColumnsRenamed({"locus": "r_locus", "iv_start": "r_start"})
    right = F.col("r_locus").isNotNull() & (F.col("l_locus").isNull() | (F.col("b_end") - F.col("r_start") > F.col("l_end") - F.col("b_start")))
    return both.withColumn("locus", F.when(F.col("l_locus").eqNullSafe(F.col("r_locus")), F.col("l_locus")).when(right, F.col("r_locus")).otherwise(F.col("l_locus"))).drop("l_locus", "l_end", "r_locus", "r_start")
