"""Single alignments and their mates: positions, regions, flags, tags and what a pair says of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.operators.fragments import READ1, UNMAPPED, flag, pair_mates

# Where a mate lies. References count by their number in the header.


def mate_before(ref: Column, pos: Column, mate_ref: Column, mate_pos: Column) -> Column:
    """Whether the mate comes before in an order by reference and position."""
    return F.when(mate_ref == ref, mate_pos < pos).otherwise(mate_ref < ref)


def mate_after(ref: Column, pos: Column, mate_ref: Column, mate_pos: Column) -> Column:
    return F.when(mate_ref == ref, mate_pos > pos).otherwise(mate_ref > ref)


def mate_same(ref: Column, pos: Column, mate_ref: Column, mate_pos: Column) -> Column:
    return (mate_ref == ref) & (mate_pos == pos)


def mate_in_region(mate_ref: Column, mate_pos: Column, ref: object, start: int, end: int) -> Column:
    """Whether the mate begins strictly between the region's bounds."""
    return (mate_ref == F.lit(ref)) & (mate_pos > start) & (mate_pos < end)


# Regions.


def region_scan(alignments: DataFrame, ref: object, start: int, end: int, length: Column) -> DataFrame:
    """Mapped alignments of a reference that overlap [start, end), 0-based; `length` is what an alignment covers.

    Alignments that are written by reference (see sinks.save_alignments) are read from that reference's files only.
    """
    at = F.col("pos") - 1
    return alignments.where((F.col("ref") == F.lit(ref)) & ~flag(UNMAPPED) & (at < end) & (at + length > start))


def region_pairs(alignments: DataFrame, ref: object, start: int, end: int, length: Column) -> DataFrame:
    """Pairs (qname, r1, r2) of the alignments in a region; those whose mate lies outside stand alone."""
    return pair_mates(region_scan(alignments, ref, start, end, length))


# Flags and tags of both reads of a pair.


def set_flag(column: Column, bit: int, on: bool = True) -> Column:
    return column.bitwiseOR(F.lit(bit)) if on else column.bitwiseAND(F.lit(~bit))


def set_tag(tags: Column, name: str, value: Column | None) -> Column:
    """The tags with one set, or without it where value is None or null."""
    rest = F.map_filter(tags, lambda k, _: k != name)
    return rest if value is None else F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def mark_pair(pairs: DataFrame, mapq: Column | None = None, bit: int | None = None, on: bool = True, tag: tuple[str, Column] | None = None) -> DataFrame:
    """Pairs (.., r1, r2) with quality, flag bit or tag set on both reads; a missing read stays missing."""

    def changed(name: str) -> Column:
        r = F.col(name)
        if mapq is not None:
            r = r.withField("mapq", mapq)
        if bit is not None:
            r = r.withField("flag", set_flag(F.col(f"{name}.flag"), bit, on))
        if tag is not None:
            r = r.withField("tags", set_tag(F.col(f"{name}.tags"), *tag))
        return F.when(F.col(name).isNotNull(), r)

    return pairs.withColumns({"r1": changed("r1"), "r2": changed("r2")})


def pair_tags(pairs: DataFrame, tag: str, order: str = "file_seq") -> DataFrame:
    """(qname, first, all): the tag of a fragment's first alignment, and of both reads of each of its alignments in order."""
    own = pairs.select("qname", F.col(f"r1.{order}").alias("at"), F.struct(F.col("r1.tags")[tag].alias("r1"), F.col("r2.tags")[tag].alias("r2")).alias("t"))
    per = own.groupBy("qname").agg(F.min_by(F.col("t.r1"), "at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "t"))).alias("all"))
    return per.select("qname", "first", F.transform("all", lambda x: x["t"]).alias("all"))


def pair_facts(pairs: DataFrame) -> DataFrame:
    """Pairs with the numbers of reads, whether they are two, whether the first is unmapped, and its reference and name."""
    return pairs.withColumns(
        {
            "num_reads": F.when(F.col("r2").isNull(), 1).otherwise(2),
            "is_pair": F.col("r2").isNotNull(),
            "is_unmapped": F.col("r1.flag").bitwiseAND(UNMAPPED) != 0,
            "ref_name": F.col("r1.ref"),
            "query_name": F.col("r1.qname"),
        }
    )


# The older ways.


def suffixed_names(alignments: DataFrame) -> DataFrame:
    """Alignments with /1 or /2 after the names of those that belong to a pair but stand alone."""
    return alignments.withColumn("qname", F.concat("qname", F.when(flag(READ1), "/1").otherwise("/2")))


def best_by_distance(alignments: DataFrame, seed: int = 0) -> DataFrame:
    """One alignment (rid, fid, sc, nm, ln) of each cell: largest sc, then smallest nm, then a seeded draw."""
    w = Window.partitionBy("rid", "fid").orderBy(F.col("sc").desc(), "nm", F.xxhash64(F.lit(seed), "rid", "ln"), "ln")
    return alignments.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def span(alignments: DataFrame) -> DataFrame:
    """(rid, begin, end) over all of a row's blocks (b_start, b_end)."""
    return alignments.groupBy("rid").agg(F.min("b_start").alias("begin"), F.max("b_end").alias("end"))
