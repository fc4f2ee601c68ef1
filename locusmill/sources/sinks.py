"""Writers: count matrices with their names, statistics, tracking files, alignments, checkpoints."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.sources.bam import Header, write_bam
from locusmill.sources.files import text_file

STATS = ("stage", "mode", "var", "value")


def _single(df: DataFrame, order: list[str], column: str, path: str) -> None:
    """One text file in order, written by streaming sorted partitions through the driver, never all at once."""
    with text_file(df.sparkSession, path) as f:
        for row in df.orderBy(*order).select(column).toLocalIterator():
            f.write(row[0] + "\n")


def matrix_market(counts: DataFrame, features: int, cells: int, path: str, comment: str = "", integer: bool = True) -> None:
    """Counts (fid, bidx, n), from 0, as a features x cells Matrix Market file, columns first."""
    kept = counts.where("n <> 0")
    n = kept.count()
    number = F.col("n").cast("long").cast("string") if integer else F.col("n").cast("string")
    body = kept.select("bidx", "fid", F.concat_ws(" ", (F.col("fid") + 1).cast("string"), (F.col("bidx") + 1).cast("string"), number).alias("value"))
    with text_file(counts.sparkSession, path) as f:
        f.write(f"%%MatrixMarket matrix coordinate {'integer' if integer else 'real'} general\n")
        for line in comment.splitlines():
            f.write(f"%{line}\n")
        f.write(f"{features} {cells} {n}\n")
        for row in body.orderBy("bidx", "fid").select("value").toLocalIterator():
            f.write(row[0] + "\n")


def names(df: DataFrame, index: str, column: str, path: str) -> None:
    _single(df, [index], column, path)


def stats(rows: DataFrame, path: str) -> None:
    """The long table of statistics, tab-separated, with a header, in the rows' order column n."""
    text = rows.select("n", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STATS]).alias("value"))
    with text_file(rows.sparkSession, path) as f:
        f.write("\t".join(STATS) + "\n")
        for row in text.orderBy("n").select("value").toLocalIterator():
            f.write(row[0] + "\n")


def stats_of(row: DataFrame, stage: str, mode: str = "") -> DataFrame:
    """A row of properties as (stage, mode, var, value), by name."""
    cols = sorted(row.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("string").alias("value")) for c in cols]))
    return row.select(F.lit(stage).alias("stage"), F.lit(mode).alias("mode"), pairs.alias("p")).select("stage", "mode", "p.var", "p.value")


def umi_tracking(comps: DataFrame, reps: DataFrame, scores: DataFrame, names_: DataFrame, path: str) -> None:
    """A line per molecule with several reads, then an indented one per read: name, component, REP or EX, its scores."""
    cells = scores.where("fid > 0").groupBy("rid").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fid", "raw"))), lambda c: F.concat(c["fid"].cast("string"), F.lit(": "), c["raw"].cast("string"))), ", "), F.lit("}")).alias("s"))
    several = comps.groupBy("bc", "umi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bc", "umi")
    rows = comps.join(several, ["bc", "umi"]).join(names_, "rid").join(cells, "rid", "left").join(reps.select("rid", F.lit("REP").alias("r")), "rid", "left")
    detail = rows.select("bc", "umi", F.lit(1).alias("o"), "rid", F.concat_ws("\t", F.lit(""), "qname", F.col("comp").cast("string"), F.coalesce("r", F.lit("EX")), F.coalesce("s", F.lit("{}"))).alias("value"))
    heads = several.select("bc", "umi", F.lit(0).alias("o"), F.lit(None).cast(dict(comps.dtypes)["rid"]).alias("rid"), F.concat_ws("\t", F.col("bc").cast("string"), F.col("umi").cast("string")).alias("value"))
    _single(heads.unionByName(detail), ["bc", "umi", "o", "rid"], "value", path)


def sam_text(rows: DataFrame) -> DataFrame:
    """Alignments as SAM lines; optional fields in the order of their tags."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.when(e["value"].rlike(r"^-?\d+$"), F.lit(":i:")).otherwise(F.lit(":Z:")), e["value"])), "\t")
    fixed = [F.col(c).cast("string") for c in ("qname", "flag", "ref", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    return rows.select("file_seq", F.concat_ws("\t", *fixed, F.when(F.size("tags") > 0, tags)).alias("value"))


def sam(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """SAM text files in a folder, ordered over all of them."""
    sam_text(rows).orderBy(*(order or ["file_seq"])).select("value").write.mode("overwrite").text(path)


def split_alignments(rows: DataFrame, overlapping: DataFrame, head: Header, inside: str, other: str) -> None:
    """Alignments of fragments that overlap a feature, and all others, in two BAM files."""
    names_ = overlapping.select("qname").distinct()
    write_bam(rows.join(names_, "qname", "left_semi"), head, inside)
    write_bam(rows.join(names_, "qname", "left_anti"), head, other)


def save_alignments(rows: DataFrame, path: str) -> None:
    """Alignments as Parquet by reference, sorted by place, so that a region reads its own files only."""
    rows.repartition("ref", F.floor(F.col("pos") / (1 << 20))).sortWithinPartitions("ref", "pos").write.mode("overwrite").partitionBy("ref").parquet(path)


def save_matrix(cells: DataFrame, shape: tuple[int, int], path: str) -> None:
    """A sparse matrix (row, col, value) with its shape."""
    cells.select("row", "col", "value").write.mode("overwrite").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([shape], "rows long, cols long").coalesce(1).write.mode("overwrite").json(f"{path}/shape")


def save_annotation(merged: DataFrame, path: str) -> None:
    merged.write.mode("overwrite").parquet(path)


def dump(df: DataFrame, path: str) -> None:
    """A table as tab-separated text in a folder, for looking at; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def save_checkpoint(tables: Mapping[str, DataFrame], options: Mapping, path: str) -> None:
    """Tables as Parquet, options as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(dict(options)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")


def load_checkpoint(spark: SparkSession, path: str, tables: list[str]) -> tuple[dict[str, DataFrame], dict]:
    options = json.loads(spark.read.text(f"{path}/options").first()[0])
    if "whitelist" in options:  # an older name
        options["filtlist"] = options.pop("whitelist")
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}, options
