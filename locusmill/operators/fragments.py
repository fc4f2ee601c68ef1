"""Alignments and fragments: codes, pairing, blocks, strand, filters and the projection of results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.functions.scalars import phred
from locusmill.operators.intervals import merged_array, total_length

# Bits of an alignment's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256
# Colours (red, green, blue) of updated alignments.
GREY, VERMILION, YELLOW, GREEN = "248,248,248", "213,94,0", "240,228,66", "210,240,215"


def flag(bit: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(bit) != 0


def fragment_codes(alignments: DataFrame) -> DataFrame:
    """Code of each fragment (qname) from the flags of its alignments, and whether it is mapped and paired.

    Unpaired: SU or SM by the first alignment; paired: PM if proper, PU if there are exactly two and both are unmapped,
    else PX. PX counts as mapped.
    """
    per = alignments.groupBy("qname").agg(F.min_by("flag", "file_seq").alias("flag"), F.count(F.lit(1)).alias("n"), F.count_if(flag(UNMAPPED)).alias("unmapped"))
    code = F.when(~flag(PAIRED), F.when(flag(UNMAPPED), "SU").otherwise("SM")).when(flag(PROPER), "PM").when((F.col("n") == 2) & (F.col("unmapped") == 2), "PU").otherwise("PX")
    return per.select("qname", code.alias("code")).withColumn("is_mapped", F.substring("code", 2, 1).isin("M", "X")).withColumn("is_paired", F.substring("code", 1, 1) == "P")


def read_key(mate: bool = False) -> Column:
    """The key by which an alignment and its mate find each other: name, read 1, and both places with the length's sign."""
    first = ~flag(READ1) if mate else flag(READ1)
    own, other = ("rnext", "pnext"), ("ref", "pos")
    a, b = (own, other) if mate else (other, own)
    return F.struct(F.col("qname"), first.alias("first"), F.col(a[0]).alias("r"), F.col(a[1]).alias("p"), F.col(b[0]).alias("mr"), F.col(b[1]).alias("mp"), (-F.col("tlen") if mate else F.col("tlen")).alias("t"))


def pair_mates(alignments: DataFrame) -> DataFrame:
    """Rows (qname, r1, r2): alignments joined with their mates, read 1 first; those without a mate alone, r2 null.

    The n-th alignment of a key goes with the n-th of the mate's key, in file order.
    """
    both = alignments.withColumn("own", read_key()).withColumn("mate", read_key(True))
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy("file_seq")))
    cols = alignments.columns
    one, two = both.where(flag(READ1)), both.where(~flag(READ1))
    left = one.select(F.struct(*cols).alias("r1"), F.col("own").alias("k"), "nth")
    right = two.select(F.struct(*cols).alias("r2"), F.col("mate").alias("k"), "nth")
    pairs = left.join(right, ["k", "nth"], "full_outer")
    return pairs.select(F.coalesce("r1.qname", "r2.qname").alias("qname"), F.coalesce("r1", "r2").alias("r1"), F.when(F.col("r1").isNotNull(), F.col("r2")).alias("r2"))


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """0-based half-open blocks of the reference that an alignment covers (1-based pos): M, = and X cover, D and N skip."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    start = F.struct((pos - 1).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, op: Column) -> Column:
        n = F.regexp_extract(op, r"^(\d+)", 1).cast("int")
        kind = F.substring(op, -1, 1)
        block = F.array(F.struct(s["at"].alias("start"), (s["at"] + n).alias("end")))
        at = F.when(kind.isin("M", "=", "X", "D", "N"), s["at"] + n).otherwise(s["at"])
        return F.struct(at.alias("at"), F.when(kind.isin("M", "=", "X"), F.concat(s["out"], block)).otherwise(s["out"]).alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Blocks merged over both reads (gaps of one base absorbed), aligned length and score (AS, summed) of pairs."""
    own = cigar_blocks(F.col("r1.pos"), F.coalesce(F.col("r1.cigar"), F.lit("")))
    mate = F.when(F.col("r2").isNotNull(), cigar_blocks(F.col("r2.pos"), F.coalesce(F.col("r2.cigar"), F.lit("")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    out = pairs.withColumn("blocks", merged_array(F.concat(own, mate), 1))
    score = F.col("r1.tags")["AS"].cast("int") + F.coalesce(F.when(F.col("r2").isNotNull(), F.col("r2.tags")["AS"].cast("int")), F.lit(0))
    return out.withColumn("alnlen", total_length(F.col("blocks"))).withColumn("alnscore", score)


def fragment_strand(mode: str, paired: str = "paired", reverse1: str = "reverse1", reverse2: str = "reverse2") -> Column:
    """Strand of the molecule: single F (that of the read) or R (the other), pairs FR (read 1's) or RF (read 2's).

    Null where the mode doesn't fit the fragment; such fragments are skipped and counted.
    """
    own, other = F.when(F.col(reverse1), "-").otherwise("+"), F.when(F.col(reverse1), "+").otherwise("-")
    mate = F.when(F.col(reverse2), "-").otherwise("+")
    pairs, single = F.col(paired), ~F.col(paired)
    return {"F": F.when(single, own), "R": F.when(single, other), "FR": F.when(pairs, own), "RF": F.when(pairs, mate)}[mode]


def filter_status(mapped: Column, barcode: Column, listed: Column, umi: Column, overlaps: Column, ignore_umi: bool = False) -> Column:
    """The first reason for which a fragment is left out, or ok."""
    out = F.when(~mapped, "unmapped").when(barcode.isNull(), "missing CB").when(~listed, "CB not listed")
    if not ignore_umi:
        out = out.when(umi.isNull(), "missing UB")
    return out.when(~overlaps, "no overlap").otherwise("ok")


def consistent_tags(reads: DataFrame) -> DataFrame:
    """(qname, first_seq, bc, umi), one row each, of reads (qname, bc, umi, file_seq); raises where tags of a name differ.

    The tags are those of the first in file order; later ones without a tag don't disagree.
    """
    low, high = (F.struct(f(F.col("bc")).alias("bc"), f(F.col("umi")).alias("umi")) for f in (F.min, F.max))
    first = F.min_by(F.struct("bc", "umi"), "file_seq")
    per = reads.groupBy("qname").agg(low.alias("low"), high.alias("high"), first.alias("t"), F.min("file_seq").alias("first_seq"))
    agree = F.col("low.bc").eqNullSafe(F.col("high.bc")) & F.col("low.umi").eqNullSafe(F.col("high.umi"))
    checked = F.when(agree, F.col("t.bc")).otherwise(F.raise_error(F.concat(F.lit("tags differ for "), "qname")).cast("string"))
    return per.select("qname", "first_seq", checked.alias("bc"), F.col("t.umi").alias("umi"))


def alignment_summary(fragments: DataFrame) -> DataFrame:
    """One row over fragments (code, status, n, low, high): how many there are, paired and single, unmapped, with one and
    with several alignments on and off features, and the scores' range. Fragments left out for their tags count no further."""
    pair, used = F.substring("code", 1, 1) == "P", F.col("status").isin("ok", "no overlap")
    on, one = F.col("status") == "ok", F.col("n") == 1
    kinds = {"loc_unique": on & one, "loc_ambig": on & ~one, "noloc_unique": ~on & one, "noloc_ambig": ~on & ~one}
    return fragments.agg(
        F.count(F.lit(1)).alias("total_fragments"),
        F.count_if(pair).alias("paired"),
        F.count_if(~pair).alias("single"),
        F.count_if(F.col("status") == "unmapped").alias("unmapped"),
        *[F.count_if(used & c).alias(k) for k, c in kinds.items()],
        F.min(F.when(used, F.col("low"))).alias("minAS"),
        F.max(F.when(used, F.col("high"))).alias("maxAS"),
    )


def errors(fragments: DataFrame) -> DataFrame:
    """Reasons for which fragments were left out, with their numbers, the commonest first."""
    left = fragments.where(~F.col("status").isin("ok", "no overlap", "unmapped"))
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def best_alignments(alignments: DataFrame) -> DataFrame:
    """Every alignment (rid, fid, sc, len, ln) with tag PRI for the best of its cell by sc + len, else SEC.

    Ties go by ln, then larger sc.
    """
    w = Window.partitionBy("rid", "fid").orderBy((F.col("sc") + F.col("len")).desc(), "ln", F.col("sc").desc())
    return alignments.withColumn("rn", F.row_number().over(w)).withColumn("tag", F.when(F.col("rn") == 1, "PRI").otherwise("SEC")).drop("rn")


def top_features(alignments: DataFrame) -> DataFrame:
    """(rid, zb): the features of a row whose alignments have its largest sc, in descending order, joined by commas."""
    top = alignments.withColumn("m", F.max("sc").over(Window.partitionBy("rid"))).where("sc = m")
    return top.groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("fid"), asc=False), lambda f: f.cast("string")), ",").alias("zb"))


def updated(alignments: DataFrame, z: DataFrame, assigned: DataFrame) -> DataFrame:
    """Alignments (rid, fid, tag, flag) with new flag, mapq, colour and xp from posteriors and assignments.

    Secondary alignments of a cell become secondary, quality 0, grey. Primary ones get the posterior as quality and
    xp; assigned ones are primary and vermilion, the others secondary, yellow from 0.2 on, else pale green.
    """
    joined = alignments.join(z.select("rid", "fid", "z"), ["rid", "fid"], "left").join(assigned.select("rid", "fid", F.lit(True).alias("won")), ["rid", "fid"], "left")
    p, won, pri = F.coalesce("z", F.lit(0.0)), F.coalesce("won", F.lit(False)), F.col("tag") == "PRI"
    return joined.select(
        *alignments.columns,
        F.when(pri & won, F.col("flag").bitwiseAND(~SECONDARY)).otherwise(F.col("flag").bitwiseOR(SECONDARY)).alias("new_flag"),
        F.when(pri, phred(p)).otherwise(0).alias("mapq"),
        F.when(pri, p).alias("xp"),
        F.when(~pri, GREY).when(won, VERMILION).when(p >= 0.2, YELLOW).otherwise(GREEN).alias("colour"),
    )


def cell_sort(alignments: DataFrame, cells: DataFrame, tag: str = "CB") -> DataFrame:
    """Mapped alignments of the listed cells, those of a cell together, by name within it."""
    kept = alignments.where(~flag(UNMAPPED)).withColumn("bc", F.col("tags")[tag]).join(cells.select("bc"), "bc", "left_semi")
    return kept.repartitionByRange("bc", "qname").sortWithinPartitions("bc", "qname", "file_seq")
