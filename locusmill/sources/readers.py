"""Readers: annotations, alignments, barcode and cell-type lists, count matrices, tracking files, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.functions.scalars import attributes, attributes_text
from locusmill.operators.fragments import UNMAPPED, flag
from locusmill.operators.index import dense_index
from locusmill.sources.bam import bam, header_rows

# Fields of an annotation row in order.
GTF_FIELDS = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_seq, value): lines of text files in order: by file, then by place; file_seq is a dense number from 0."""
    text = spark.read.text(path)
    placed = text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    return dense_index(placed, ["f", "b", "at"]).select(F.col("idx").alias("file_seq"), "value")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows: the fields, and line (from 0). Comment lines are left out, as are rows of fewer than nine fields.

    start and end are -1 where they are no integers, score and frame null; attributes are a map of strings.
    """
    rows = lines(spark, path).where(~F.col("value").startswith("#"))
    c = F.split("value", "\t")
    return rows.where(F.size(c) >= 9).select(
        c[0].alias("chrom"),
        c[1].alias("source"),
        c[2].alias("feature"),
        F.coalesce(F.trim(c[3]).try_cast("int"), F.lit(-1)).alias("start"),
        F.coalesce(F.trim(c[4]).try_cast("int"), F.lit(-1)).alias("end"),
        F.trim(c[5]).try_cast("int").alias("score"),
        c[6].alias("strand"),
        F.trim(c[7]).try_cast("int").alias("frame"),
        attributes(c[8]).alias("attributes"),
        F.col("file_seq").alias("line"),
    )


def gtf_text(rows: DataFrame) -> DataFrame:
    """Annotation rows as lines of text: missing numbers and names as a dot."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GTF_FIELDS[:-1]]
    return rows.select(F.concat_ws("\t", *cells, F.coalesce(attributes_text(F.col("attributes")), F.lit(""))).alias("value"))


def annotation(rows: DataFrame, feature: str = "exon", key: str = "locus", stranded: bool = False) -> DataFrame:
    """Merged half-open intervals (chrom[, strand], iv_start, iv_end, locus) of the rows of a feature type that have the key."""
    from locusmill.operators.intervals import merge_intervals

    wanted = rows.where((F.col("feature") == feature) & F.col("attributes")[key].isNotNull())
    by = ["locus", "chrom", *(["strand"] if stranded else [])]
    iv = wanted.select(F.col("attributes")[key].alias("locus"), "chrom", "strand", F.col("start").cast("long").alias("iv_start"), (F.col("end") + 1).cast("long").alias("iv_end"))
    return merge_intervals(iv, by)


def sam_tags(fields: Column) -> Column:
    """A map from tag to value of optional fields TAG:TYPE:VALUE."""
    pairs = F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 30).alias("v")))
    return F.map_from_entries(pairs)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text files, header lines left out, file_seq numbering them in file order."""
    c = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    names = {0: "qname", 2: "ref", 5: "cigar", 6: "rnext", 9: "seq", 10: "qual"}
    numbers = {1: "flag", 3: "pos", 4: "mapq", 7: "pnext", 8: "tlen"}
    cols = {**{i: c[i].alias(n) for i, n in names.items()}, **{i: c[i].cast("int").alias(n) for i, n in numbers.items()}}
    return rows.select(*[cols[i] for i in range(11)], sam_tags(F.slice(c, F.lit(12), F.greatest(F.size(c) - 11, F.lit(0)))).alias("tags"), "file_seq")


def header(spark: SparkSession, path: str) -> DataFrame:
    """References (ref, length) of a SAM or BAM header."""
    if path.endswith(".bam"):
        return header_rows(spark, path)
    h = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return h.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def reference_counts(alignments_: DataFrame, refs: DataFrame) -> DataFrame:
    """References (ref, length) with their mapped and unmapped alignments, and a last row, *, of those without a place."""
    per = alignments_.groupBy("ref").agg(F.count_if(~flag(UNMAPPED)).alias("mapped"), F.count_if(flag(UNMAPPED)).alias("unmapped"))
    every = refs.unionByName(refs.sparkSession.createDataFrame([("*", 0)], "ref string, length long"))
    return every.join(per, "ref", "left").na.fill(0, ["mapped", "unmapped"])


def alignments(spark: SparkSession, path: str) -> DataFrame:
    return bam(spark, path) if path.endswith(".bam") else sam(spark, path)


def saved_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments that sinks.save_alignments has written, by reference."""
    return spark.read.parquet(path)


def saved_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """A matrix (row, col, value) that sinks.save_matrix has written, and its shape."""
    shape = spark.read.json(f"{path}/shape").first()
    return spark.read.parquet(f"{path}/cells"), (shape["rows"], shape["cols"])


def saved_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Merged intervals that sinks.save_annotation has written."""
    return spark.read.parquet(path)


def distinct_types(types: DataFrame) -> DataFrame:
    """The cell types there are, in order."""
    return types.select("celltype").distinct().orderBy("celltype")


BARCODE = r"^[ACGTacgt]+$"


def without_header(rows: DataFrame, header: bool | None) -> DataFrame:
    """Drops a first line: always (True), never (False), or when it doesn't look like a barcode (None)."""
    if header is False:
        return rows
    first = F.col("file_seq") == 0
    return rows.where(~first if header else (~first | F.col("bc").rlike(BARCODE)))


def barcodes(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """(bidx, bc): the first column of a tab-separated list in order, repetitions ignored."""
    c = lines(spark, path).select("file_seq", F.split("value", "\t")[0].alias("bc")).where("bc <> ''")
    firsts = without_header(c, header).groupBy("bc").agg(F.min("file_seq").alias("at"))
    return dense_index(firsts, ["at"]).select(F.col("idx").alias("bidx"), "bc")


def celltypes(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """(bc, celltype) of a tab-separated list; raises where a barcode has two types."""
    c = F.split("value", "\t")
    rows = without_header(lines(spark, path).where(F.size(c) >= 2).select("file_seq", c[0].alias("bc"), c[1].alias("celltype")), header)
    per = rows.groupBy("bc").agg(F.countDistinct("celltype").alias("n"), F.first("celltype").alias("celltype"))
    return per.select("bc", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two cell types for "), "bc"))).otherwise(F.col("celltype")).alias("celltype"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), from 1, of a coordinate Matrix Market file."""
    body = lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size_line = body.agg(F.min("file_seq")).scalar()
    c = F.split(F.trim("value"), r"\s+")
    return body.withColumn("s_", size_line).where("file_seq > s_").select(c[0].cast("long").alias("row"), c[1].cast("long").alias("col"), c[2].cast("double").alias("value"))


def umi_tracking(spark: SparkSession, path: str) -> DataFrame:
    """(bc, umi, qname, comp, status, scores) of a tracking file: a line per molecule, then an indented line per read.

    Detail lines belong to the molecule line before them; a molecule's lines are found by range and filled forward
    within their part, the last molecule of the parts before being carried over.
    """
    c = F.split("value", "\t")
    rows = lines(spark, path).withColumn("head", ~F.col("value").startswith("\t"))
    rows = rows.withColumn("m", F.when(F.col("head"), F.struct(c[0].alias("bc"), c[1].alias("umi")))).withColumn("chunk", F.floor(F.col("file_seq") / 100_000))
    order = Window.partitionBy("chunk").orderBy("file_seq").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("own", F.last("m", True).over(order))
    lasts = rows.where("head").groupBy("chunk").agg(F.max_by("m", "file_seq").alias("l"))
    carried = rows.select("chunk").distinct().join(lasts, "chunk", "left").select("chunk", F.last("l", True).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    full = own.join(carried, "chunk").where("not head").withColumn("mol", F.coalesce("own", "carry"))
    return full.select("mol.bc", "mol.umi", c[1].alias("qname"), c[2].cast("int").alias("comp"), c[3].alias("status"), c[4].alias("scores"))
