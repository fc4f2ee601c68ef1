"""Whole runs: assign, resume, cellsort and merge."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusmill.operators import em, fragments, intervals, reassign, umi
from locusmill.operators.index import dense_index, features
from locusmill.plans import logs
from locusmill.plans.options import AssignOptions, derived_seed, option_rows, resumed
from locusmill.scratch import Scratch
from locusmill.sources import readers, sinks
from locusmill.sources.bam import Header, header_of, write_bam


@dataclass
class Loaded:
    """Tables of a loaded run: features (fid, locus), cells (bidx, bc), reads (rid, qname, bc, umi), scores (rid, fid,
    raw), placed (alignments with their feature), status (counts by reason), summary (one row of all fragments), heads
    (the header of the alignments, by lines), celltypes (bc, celltype) where given, rows (all alignments) while a run lasts."""

    features: DataFrame
    cells: DataFrame
    reads: DataFrame
    scores: DataFrame
    placed: DataFrame
    status: DataFrame
    summary: DataFrame
    heads: DataFrame
    celltypes: DataFrame | None = None
    rows: DataFrame | None = None

    def head(self) -> Header:
        """The header; as many rows as there are references."""
        r = self.heads.first()
        return Header(r.text, list(r.names), list(r.lengths))


def alignment_pairs(rows: DataFrame) -> DataFrame:
    """(qname, aln, first_seq, r1, r2, ...metrics): pairs and single alignments that are mapped."""
    mapped = rows.where(~fragments.flag(fragments.UNMAPPED))
    paired = fragments.pair_mates(mapped.where(fragments.flag(fragments.PAIRED)))
    kind = paired.schema["r1"].dataType.simpleString()
    single = mapped.where(~fragments.flag(fragments.PAIRED)).select("qname", F.struct(*rows.columns).alias("r1"), F.lit(None).cast(kind).alias("r2"))
    both = fragments.pair_metrics(paired.unionByName(single))
    return both.withColumn("aln", F.col("r1.file_seq"))


def load(spark: SparkSession, o: AssignOptions, scratch: Scratch) -> Loaded:
    rows = scratch.keep(readers.alignments(spark, o.alignments), "alignments")
    annotated = readers.annotation(readers.gtf(spark, o.annotation), o.feature_type, o.attribute, bool(o.stranded_mode))
    loci = scratch.keep(annotated, "annotation")
    index = scratch.keep(features(loci, o.no_feature_key), "features")
    types = readers.celltypes(spark, o.celltype_tsv) if o.celltype_tsv else None
    codes = fragments.fragment_codes(rows)
    own = fragments.consistent_tags(rows.select("qname", F.col("tags")[o.barcode_tag].alias("bc"), F.col("tags")[o.umi_tag].alias("umi"), "file_seq"))
    tagged = codes.join(own, "qname").select("qname", "code", "is_mapped", "first_seq", "bc", "umi")
    cells = scratch.keep(readers.barcodes(spark, o.filtered_bc) if o.filtered_bc else dense_index(tagged.where("bc is not null").select("bc").distinct(), ["bc"]).select(F.col("idx").alias("bidx"), "bc"), "cells")
    tagged = tagged.join(cells.select("bc", F.lit(True).alias("listed")), "bc", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    usable = fragments.filter_status(F.col("is_mapped"), F.col("bc"), F.col("listed"), F.col("umi"), F.lit(True), o.ignore_umi)
    tagged = scratch.keep(tagged.withColumn("status", usable), "tagged")
    pairs = alignment_pairs(rows).join(tagged.where("status = 'ok'").select("qname", "bc", "umi", "first_seq"), "qname")
    strand = fragments.fragment_strand(o.stranded_mode, "p", "v1", "v2") if o.stranded_mode else F.lit(None).cast("string")
    pairs = pairs.withColumns({"p": F.col("r2").isNotNull(), "v1": F.col("r1.flag").bitwiseAND(fragments.REVERSE) != 0, "v2": F.coalesce(F.col("r2.flag").bitwiseAND(fragments.REVERSE) != 0, F.lit(False))})
    pairs = pairs.withColumn("strand", strand).withColumn("chrom", F.col("r1.ref"))
    pairs = scratch.keep(pairs.select("qname", "aln", "first_seq", "bc", "umi", "chrom", "strand", "blocks", "alnlen", "alnscore", "r1", "r2"), "pairs")
    b = pairs.select("aln", "chrom", "strand", F.explode("blocks").alias("b")).select("aln", "chrom", "strand", F.col("b.start").cast("long").alias("b_start"), F.col("b.end").cast("long").alias("b_end"))
    over = intervals.block_overlaps(b, loci, ["aln"], ["chrom", *(["strand"] if o.stranded_mode else [])], 0 if o.annotation_class == "htseq" else 1)
    best = intervals.assign_locus(over, pairs.select("aln", "alnlen"), ["aln"], o.overlap_threshold, o.no_feature_key)
    placed = pairs.join(best.select("aln", "locus"), "aln").join(index, "locus")
    placed = scratch.keep(placed.withColumn("hit", F.max(F.when(F.col("fid") > 0, 1).otherwise(0)).over(Window.partitionBy("qname"))), "placed")
    reads = dense_index(placed.where("hit = 1").groupBy("qname").agg(F.min("first_seq").alias("at"), F.first("bc").alias("bc"), F.first("umi").alias("umi")), ["at"])
    reads = scratch.keep(reads.select(F.col("idx").alias("rid"), "qname", "bc", "umi"), "reads")
    least = placed.agg(F.min("alnscore")).scalar()
    raw = placed.where("hit = 1").join(reads.select("qname", "rid"), "qname").withColumn("raw", (F.col("alnscore") - least + 1 + F.col("alnlen")).cast("long"))
    scores = scratch.keep(raw.groupBy("rid", "fid").agg(F.max("raw").alias("raw")), "scores")
    hits = placed.groupBy("qname").agg(F.max("hit").alias("hit"))
    status = tagged.join(hits, "qname", "left").withColumn("status", F.when((F.col("status") == "ok") & (F.coalesce("hit", F.lit(0)) == 0), "no overlap").otherwise(F.col("status")))
    per = pairs.groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("alnscore").alias("low"), F.max("alnscore").alias("high"))
    status = scratch.keep(status.select("qname", "code", "status").join(per, "qname", "left"), "fragments")
    counts = scratch.keep(status.groupBy("status", "code").agg(F.count(F.lit(1)).alias("n")), "status")
    summary = scratch.keep(fragments.alignment_summary(status), "summary")
    head = header_of(spark, o.alignments)
    heads = spark.createDataFrame([(head.text, head.names, head.lengths)], "text string, names array<string>, lengths array<long>")
    logs.say(logs.alignment_lines(summary.first().asDict()))
    logs.say(logs.error_lines([tuple(r) for r in fragments.errors(status).collect()]))  # a few reasons
    return Loaded(index, cells, reads, scores, placed, counts, summary, heads, types, rows)


def pooled(scores: DataFrame, reads: DataFrame, o: AssignOptions, types: DataFrame | None) -> DataFrame:
    """Scores with their pool; cells without a type are in no pool."""
    if o.pooling_mode == "pseudobulk":
        return scores.withColumn("pool", F.lit("all"))
    by = reads.select("rid", "bc")
    if o.pooling_mode == "individual":
        return scores.join(by.withColumnRenamed("bc", "pool"), "rid")
    return scores.join(by.join(types, "bc").select("rid", F.col("celltype").alias("pool")), "rid")


def finish(spark: SparkSession, o: AssignOptions, t: Loaded, scratch: Scratch, corrected: DataFrame | None = None) -> dict[str, DataFrame]:
    """From loaded tables to counts: molecule correction, fit, reassignment; results by name."""
    out: dict[str, DataFrame] = {}
    scores = t.scores
    if not o.ignore_umi:
        if corrected is None:
            comps = scratch.keep(umi.components(t.reads, t.scores), "components")
            reps = scratch.keep(umi.representatives(comps, t.scores), "representatives")
            corrected = scratch.keep(umi.corrected(t.scores, reps), "corrected")
            whole = scratch.keep(umi.whole_summary(umi.reads_per_umi(t.reads), comps), "umi-summary")
            out |= {"components": comps, "representatives": reps, "umi": whole, "umi:bins": umi.histogram(umi.reads_per_umi(t.reads)), "umi:components": umi.component_summary(comps)}
            bins, kinds = ([tuple(r) for r in out[k].collect()] for k in ("umi:bins", "umi:components"))  # a few rows
            logs.say(logs.umi_lines(whole.first().asDict(), sorted(bins, key=lambda b: (b[0].startswith(">"), len(b[0]), b[0])), sorted(kinds)))
        out["corrected"] = scores = corrected
    if o.skip_em:
        return out
    rows = t.reads.count()
    k = t.features.count()
    cells = scratch.keep(pooled(scores, t.reads, o, t.celltypes), "pooled")
    params = scratch.keep(em.fit(cells, em.Options(k, o.pi_prior, o.theta_prior, o.em_epsilon, o.max_iter, o.use_likelihood, sparse=True), scratch), "params")
    z = scratch.keep(em.posteriors(cells, params), "z")
    out |= {"params": params, "z": z, "selection": em.model_selection(cells, params)}
    seed = o.seed if o.seed is not None and o.seed >= 0 else 0
    counts = reassign.umi_counts_by_cell if o.umi_counts else reassign.counts_by_cell
    for mode in o.reassign_mode:
        w = reassign.reassign(z if mode.startswith("best") else scores, mode, o.conf_prob, seed)
        out[f"assigned:{mode}"] = w
        out[f"summary:{mode}"] = reassign.summary(z if mode.startswith("best") else scores, mode, rows, o.conf_prob)
        out[f"counts:{mode}"] = counts(w, t.reads).join(t.cells, "bc").select("bidx", "fid", "n")
    return out


def report(spark: SparkSession, o: AssignOptions, t: Loaded, out: dict[str, DataFrame]) -> None:
    """Count matrices, names, statistics and, where asked for, updated alignments in the output folder."""
    k, c = t.features.count(), t.cells.count()
    if o.skip_em:
        statistics(spark, o, t, out)
        return
    for i, mode in enumerate(o.reassign_mode):
        name = "TE_counts.mtx" if i == 0 else f"TE_counts.{mode}.mtx"
        sinks.matrix_market(out[f"counts:{mode}"], k, c, o.outfile(name), f"mode: {mode}\npooling: {o.pooling_mode}", mode != "best_average")
    sinks.names(t.cells, "bidx", "bc", o.outfile("barcodes.tsv"))
    sinks.names(t.features, "fid", "locus", o.outfile("features.tsv"))
    statistics(spark, o, t, out)
    if o.updated_sam:
        write_bam(updated_alignments(t, out, o.reassign_mode[0]), t.head(), o.outfile("updated.bam"))


def statistics(spark: SparkSession, o: AssignOptions, t: Loaded, out: dict[str, DataFrame]) -> None:
    """The table of statistics by stage: options, fragments, molecules, fit, reassignment."""
    rows = option_rows(spark, o).unionByName(sinks.stats_of(t.summary, "alignments"))
    rows = rows.unionByName(t.status.select(F.lit("fragments").alias("stage"), F.col("code").alias("mode"), F.col("status").alias("var"), F.col("n").cast("string").alias("value")))
    if "umi" in out:
        rows = rows.unionByName(sinks.stats_of(out["umi"], "molecules"))
        for name, key, what in (("umi:bins", "bin", "reads"), ("umi:components", "components", "components")):
            rows = rows.unionByName(out[name].select(F.lit("molecules").alias("stage"), F.lit(what).alias("mode"), F.col(key).cast("string").alias("var"), F.col("umis").cast("string").alias("value")))
    for mode in o.reassign_mode if not o.skip_em else ():
        rows = rows.unionByName(sinks.stats_of(out[f"summary:{mode}"].drop("mode"), "reassign", mode))
        logs.say(logs.reassign_lines(out[f"summary:{mode}"].first().asDict()))
    if "selection" in out:
        rows = rows.unionByName(sinks.stats_of(out["selection"], "fit", o.pooling_mode))
    sinks.stats(rows.withColumn("n", F.monotonically_increasing_id()), o.outfile("stats.final.tsv"))


def updated_alignments(t: Loaded, out: dict[str, DataFrame], mode: str) -> DataFrame:
    """Alignments of assigned fragments with new flags, qualities, colours (YC), posteriors (XP) and features (ZF)."""
    rows = t.placed.where("hit = 1").join(t.reads.select("qname", "rid"), "qname")
    rows = rows.select("rid", "fid", "locus", F.col("alnscore").alias("sc"), F.col("alnlen").cast("int").alias("len"), F.col("aln").alias("ln"), "r1", "r2", F.col("r1.flag").alias("flag"))
    tagged = fragments.updated(fragments.best_alignments(rows), out["z"], out[f"assigned:{mode}"])
    changed = tagged.select("locus", "colour", "xp", "mapq", "new_flag", F.explode(F.filter(F.array("r1", "r2"), lambda r: r.isNotNull())).alias("r"))
    secondary = F.col("new_flag").bitwiseAND(fragments.SECONDARY) != 0
    flag = F.when(secondary, F.col("r.flag").bitwiseOR(fragments.SECONDARY)).otherwise(F.col("r.flag").bitwiseAND(~fragments.SECONDARY))
    more = F.map_filter(F.create_map(F.lit("ZF"), F.col("locus"), F.lit("YC"), F.col("colour"), F.lit("XP"), F.round("xp", 6).cast("string")), lambda k, v: v.isNotNull())
    tags = F.map_concat(F.map_filter("r.tags", lambda k, v: ~k.isin("ZF", "YC", "XP")), more)
    fixed = [F.col(f"r.{c}").alias(c) for c in ("qname", "ref", "pos", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "file_seq")]
    return changed.select(*fixed, flag.alias("flag"), "mapq", tags.alias("tags"))


CHECKPOINT = ("features", "cells", "reads", "scores", "placed", "status", "summary", "heads")


def checkpoint(o: AssignOptions, t: Loaded, out: dict[str, DataFrame], name: str) -> None:
    """The loaded tables, and the corrected scores where there are any, with the options."""
    tables = {n: getattr(t, n) for n in CHECKPOINT} | ({"celltypes": t.celltypes} if t.celltypes is not None else {}) | ({"corrected": out["corrected"]} if "corrected" in out else {})
    sinks.save_checkpoint(tables, asdict(o) | {"tables": sorted(tables)}, o.outfile(f"checkpoint.{name}"))


def assign(spark: SparkSession, o: AssignOptions) -> dict[str, DataFrame]:
    """The whole run: load, molecule correction, fit, reassignment and report, with a checkpoint after each of the first
    two and at the end. With updated_sam the alignments on and off features are written too, each in a file."""
    if o.seed is None or o.seed == -1:
        o = AssignOptions(**{**asdict(o), "seed": derived_seed(o, spark)})
    scratch = Scratch(spark, "assign")
    with logs.stage(1, "load annotation and alignments"):
        t = load(spark, o, scratch)
        checkpoint(o, t, {}, "load_alignment")
        if o.updated_sam:
            sinks.split_alignments(t.rows, t.reads, t.head(), o.outfile("tmp_tele.bam"), o.outfile("other.bam"))
    with logs.stage(2, "remove duplicates, fit and reassign"):
        out = finish(spark, o, t, scratch)
        if "components" in out:
            sinks.umi_tracking(out["components"], out["representatives"], out["scores"] if "scores" in out else t.scores, t.reads.select("rid", "qname"), o.outfile("umi_tracking.txt"))
            checkpoint(o, t, out, "dedup_umi")
    with logs.stage(3, "report"):
        report(spark, o, t, out)
        checkpoint(o, t, out, "final")
    return out | {n: getattr(t, n) for n in CHECKPOINT}


def resume(spark: SparkSession, checkpoint_: str, **given) -> dict[str, DataFrame]:
    """A run from a checkpoint on, with other options for fit, reassignment and report."""
    _, saved = sinks.load_checkpoint(spark, checkpoint_, [])
    tables, _ = sinks.load_checkpoint(spark, checkpoint_, saved["tables"])
    o = resumed(saved, given)
    types = readers.celltypes(spark, given["celltype_tsv"]) if given.get("celltype_tsv") else tables.get("celltypes")
    t = Loaded(*(tables[n] for n in CHECKPOINT), types)
    scratch = Scratch(spark, "resume")
    with logs.stage(1, "fit and reassign"):
        out = finish(spark, o, t, scratch, None if o.ignore_umi else tables.get("corrected"))
    with logs.stage(2, "report"):
        report(spark, o, t, out)
        checkpoint(o, t, out, "final")
    return out


def cellsort(spark: SparkSession, alignments: str, filtered_bc: str, out: str, tag: str = "CB") -> None:
    """Mapped alignments of the listed cells, sorted by cell and name: a BAM file, or for other names SAM text in a folder."""
    rows = fragments.cell_sort(readers.alignments(spark, alignments), readers.barcodes(spark, filtered_bc), tag)
    order = ["bc", "qname", "file_seq"]
    if out.endswith(".bam"):
        write_bam(rows, header_of(spark, alignments), out, order)
        return
    text = sinks.sam_text(rows.withColumn("file_seq", F.struct(*order)))
    text.orderBy("file_seq").select("value").write.mode("overwrite").text(out)


def merge_files(spark: SparkSession, a: tuple[str, str, str], b: tuple[str, str, str], outdir: str = ".", exp_tag: str = "locusmill") -> tuple[DataFrame, DataFrame, DataFrame]:
    """merge, and its matrix, features and cells in files."""
    scratch = Scratch(spark, "merge")
    counts, feats, cells = (scratch.keep(df, n) for df, n in zip(merge(spark, a, b), ("counts", "features", "cells"), strict=True))
    o = AssignOptions(outdir=outdir, exp_tag=exp_tag)
    whole = counts.where(F.col("n") != F.floor("n")).isEmpty()
    sinks.matrix_market(counts, feats.count(), cells.count(), o.outfile("merged_counts.mtx"), integer=whole)
    sinks.names(feats, "fid", "locus", o.outfile("merged_features.tsv"))
    sinks.names(cells, "bidx", "bc", o.outfile("merged_barcodes.tsv"))
    if not min(cells.count(), 1):
        logs.LOG.warning("no cell is in both")
    return counts, feats, cells


def merge(spark: SparkSession, a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two runs' (matrix, features, barcodes) over the cells in both: counts (fid, bidx, n), features, cells."""

    def read(paths: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
        m = readers.matrix_market(spark, paths[0])
        f = readers.lines(spark, paths[1]).select(F.col("file_seq").alias("fid"), F.split("value", "\t")[0].alias("locus"))
        c = readers.barcodes(spark, paths[2], False)
        return m.select((F.col("row") - 1).alias("fid"), (F.col("col") - 1).alias("bidx"), F.col("value").alias("n")).join(c, "bidx").select("bc", "fid", "n"), f

    (ma, fa), (mb, fb) = read(a), read(b)
    offset = fa.count()
    counts = reassign.merge_counts(ma, mb, offset)
    cells = dense_index(counts.select("bc").distinct(), ["bc"]).select(F.col("idx").alias("bidx"), "bc")
    return counts.join(cells, "bc").select("fid", "bidx", "n"), fa.unionByName(fb.withColumn("fid", F.col("fid") + offset)), cells

