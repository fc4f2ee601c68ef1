"""Sources, sinks and whole runs on a small SAM and annotation."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from locusmill.__main__ import main
from locusmill.operators import segments
from locusmill.plans import options, pipeline
from locusmill.plans.options import AssignOptions
from locusmill.sources import bam, readers, sinks

GTF = "\n".join(["### locus ###", *(f'{c}\ttest\texon\t{s}\t{e}\t.\t{d}\t.\tgene_id "{n}"; locus "{n}";' for c, s, e, d, n in [("chr1", 101, 200, "+", "L1"), ("chr1", 301, 400, "+", "L2"), ("chr2", 101, 150, "-", "L3"), ("chr2", 152, 200, "-", "L3")]), "short\trow"]) + "\n"


def line(name, flag, ref, pos, score, bc, umi, cigar="40M"):
    return f"{name}\t{flag}\t{ref}\t{pos}\t60\t{cigar}\t*\t0\t0\t*\t*\tAS:i:{score}" + (f"\tCB:Z:{bc}" if bc else "") + (f"\tUB:Z:{umi}" if umi else "")


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n" + "\n".join(
    [
        line("r1", 0, "chr1", 110, 40, "AAAA", "G1"),
        line("r2", 0, "chr1", 120, 40, "AAAA", "G1"),
        line("r3", 0, "chr1", 310, 38, "AAAA", "G2"),
        line("r3", 256, "chr2", 110, 38, "AAAA", "G2"),
        line("r4", 0, "chr1", 600, 40, "CCCC", "G3"),
        line("r5", 0, "chr2", 110, 40, "CCCC", "G4"),
        line("r6", 0, "chr2", 110, 40, None, "G4"),
        line("r7", 0, "chr2", 110, 40, "TTTT", "G4"),
        line("r8", 0, "chr2", 110, 40, "CCCC", None),
        line("r9", 4, "*", 0, 0, "CCCC", "G9", "*"),
    ]
)


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "a.sam").write_text(SAM + "\n")
    (tmp_path / "bc.tsv").write_text("barcode\tx\nAAAA\t1\nCCCC\t2\nAAAA\t1\n")
    (tmp_path / "ct.tsv").write_text("AAAA\tT\nCCCC\tB\n")
    return tmp_path


def test_gtf(spark, inputs):
    rows = readers.gtf(spark, str(inputs / "a.gtf"))
    assert rows.count() == 4 and rows.orderBy("line").first().attributes["locus"] == "L1"
    merged = readers.annotation(rows).orderBy("locus", "iv_start").collect()
    assert [(r.locus, r.iv_start, r.iv_end) for r in merged] == [("L1", 101, 201), ("L2", 301, 401), ("L3", 101, 201)]
    text = readers.gtf_text(rows.orderBy("line")).first()[0]
    assert text.startswith("chr1\ttest\texon\t101\t200\t.\t+\t.\t") and 'locus "L1";' in text


def test_lists(spark, inputs):
    assert [(r.bidx, r.bc) for r in readers.barcodes(spark, str(inputs / "bc.tsv")).orderBy("bidx").collect()] == [(0, "AAAA"), (1, "CCCC")]
    assert readers.barcodes(spark, str(inputs / "bc.tsv"), False).count() == 3
    (inputs / "bad.tsv").write_text("AAAA\tT\nAAAA\tB\n")
    with pytest.raises(Exception, match="two cell types"):
        readers.celltypes(spark, str(inputs / "bad.tsv")).collect()


def test_sam_round_trip(spark, inputs):
    rows = readers.sam(spark, str(inputs / "a.sam"))
    assert rows.count() == 10
    got = [r.value for r in sinks.sam_text(rows).orderBy("file_seq").collect()]
    assert [g.split("\t")[:11] for g in got] == [x.split("\t")[:11] for x in SAM.split("\n")[3:]]
    assert [(r.ref, r.length) for r in readers.header(spark, str(inputs / "a.sam")).collect()] == [("chr1", 1000), ("chr2", 500)]


def many(n, rng):
    """SAM lines of n alignments of all kinds."""
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 90)))
        qual = "".join(chr(33 + rng.randrange(60)) for _ in seq)
        cigar = f"{max(1, len(seq) // 2)}M{rng.randrange(1, 9)}N{max(1, len(seq) // 3)}M2S"
        ref = rng.choice(["chr1", "chr2"])
        out.append(f"read{i % 997}.{rng.random():.9f}\t{rng.randrange(2048)}\t{ref}\t{rng.randrange(1, 400)}\t{rng.randrange(255)}\t{cigar}\t{rng.choice(['=', 'chr1' if ref == 'chr2' else 'chr2', '*'])}\t{rng.randrange(0, 300)}\t{rng.randrange(-900, 900)}\t{seq or '*'}\t{qual or '*'}\tAS:i:{rng.randrange(-5, 99)}\tCB:Z:AAAA\tXX:Z:{'x' * rng.randrange(300)}")
    return out


def test_bam(spark, tmp_path):
    """A file of many blocks, read in many splits, gives back what was written, in order; blocks hold no hint of the splits."""
    rng = random.Random(3)
    text = many(6000, rng)
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n" + "\n".join(text) + "\n")
    rows = readers.sam(spark, str(tmp_path / "a.sam"))
    head = bam.header_of(spark, str(tmp_path / "a.sam"))
    assert (head.names, head.lengths) == (["chr1", "chr2"], [1000, 500])
    path = str(tmp_path / "a.bam")
    bam.write_bam(rows, head, path)
    assert gzip.open(path).read(4) == b"BAM\x01" and open(path, "rb").read().endswith(bam.LAST_BLOCK)
    assert [(r.ref, r.length) for r in readers.header(spark, path).collect()] == [("chr1", 1000), ("chr2", 500)]
    size = os.path.getsize(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (size // 7, size // 2, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = readers.alignments(spark, path)
            assert most > size or bam.blocks(spark, path).rdd.getNumPartitions() > 1
            assert [r.value for r in sinks.sam_text(got).orderBy("file_seq").collect()] == text
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # alignments across blocks, as other writers leave them
    data = gzip.open(path).read()
    whole = b"".join(bam.deflate(data[k : k + 5000]) for k in range(0, len(data), 5000)) + bam.LAST_BLOCK
    (tmp_path / "b.bam").write_bytes(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", len(whole) // 9)
    try:
        assert [r.value for r in sinks.sam_text(readers.bam(spark, str(tmp_path / "b.bam"))).orderBy("file_seq").collect()] == text
        (tmp_path / "c.bam").write_bytes(whole[: len(whole) // 2])
        with pytest.raises(Exception, match="cut|damaged"):
            readers.bam(spark, str(tmp_path / "c.bam")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_regions(spark, inputs):
    rows = readers.sam(spark, str(inputs / "a.sam"))
    sinks.save_alignments(rows, str(inputs / "byref"))
    saved = readers.saved_alignments(spark, str(inputs / "byref"))
    got = segments.region_scan(saved, "chr2", 100, 111, F.lit(40)).orderBy("qname").collect()
    assert [r.qname for r in got] == ["r3", "r5", "r6", "r7", "r8"]
    assert segments.region_scan(saved, "chr2", 160, 400, F.lit(40)).isEmpty()
    counts = {r.ref: (r.mapped, r.unmapped) for r in readers.reference_counts(rows, readers.header(spark, str(inputs / "a.sam"))).collect()}
    assert counts == {"chr1": (4, 0), "chr2": (5, 0), "*": (0, 1)}


def test_saved_tables(spark, inputs):
    cells = spark.createDataFrame([(0, 1, 2.5), (3, 0, 1.0)], "row long, col long, value double")
    sinks.save_matrix(cells, (4, 2), str(inputs / "m"))
    back, shape = readers.saved_matrix(spark, str(inputs / "m"))
    assert shape == (4, 2) and sorted(map(tuple, back.collect())) == [(0, 1, 2.5), (3, 0, 1.0)]
    merged = readers.annotation(readers.gtf(spark, str(inputs / "a.gtf")))
    sinks.save_annotation(merged, str(inputs / "ann"))
    assert sorted(map(tuple, readers.saved_annotation(spark, str(inputs / "ann")).collect())) == sorted(map(tuple, merged.collect()))
    sinks.dump(spark.createDataFrame([(1, {"a": "b"})], "x int, m map<string,string>"), str(inputs / "dump"))
    assert sorted({r.value for r in spark.read.text(str(inputs / "dump")).collect()}, reverse=True) == ["x\tm", '1\t"{\\"a\\":\\"b\\"}"']
    assert [r.celltype for r in readers.distinct_types(readers.celltypes(spark, str(inputs / "ct.tsv"))).collect()] == ["B", "T"]


def test_other_file_systems(spark, inputs):
    """A run whose inputs and outputs are URLs writes the same files."""
    url = f"file://{inputs}"
    o = AssignOptions(f"{url}/a.sam", f"{url}/a.gtf", outdir=f"{url}/far", ignore_umi=True)
    local = AssignOptions(str(inputs / "a.sam"), str(inputs / "a.gtf"), outdir=str(inputs / "near"), ignore_umi=True)
    assert options.derived_seed(o, spark) == options.derived_seed(local)
    for x in (o, local):
        pipeline.assign(spark, x)
    for name in ("TE_counts.mtx", "features.tsv", "barcodes.tsv"):
        assert (inputs / "far" / f"locusmill-{name}").read_text() == (inputs / "near" / f"locusmill-{name}").read_text()


def test_tags_that_differ(spark, inputs):
    (inputs / "bad.sam").write_text(SAM + "\n" + line("r3", 256, "chr2", 110, 38, "CCCC", "G2") + "\n")
    with pytest.raises(Exception, match="tags differ for r3"):
        pipeline.assign(spark, AssignOptions(str(inputs / "bad.sam"), str(inputs / "a.gtf"), outdir=str(inputs / "x"), seed=1))


def test_command_line(spark, inputs, capsys):
    """All commands, and every file that they write."""
    out = str(inputs / "cli")
    log = str(inputs / "log.txt")
    main(["assign", str(inputs / "a.sam"), str(inputs / "a.gtf"), "--filtered_bc", str(inputs / "bc.tsv"), "--outdir", out, "--reassign_mode", "best_exclude,total_hits", "--updated_sam", "--seed", "5", "--logfile", log], spark)
    assert sorted(os.listdir(out)) == sorted(
        f"locusmill-{n}"
        for n in ("TE_counts.mtx", "TE_counts.total_hits.mtx", "barcodes.tsv", "features.tsv", "stats.final.tsv", "umi_tracking.txt", "updated.bam", "tmp_tele.bam", "other.bam", "checkpoint.load_alignment", "checkpoint.dedup_umi", "checkpoint.final")
    ) or {f for f in os.listdir(out) if not f.startswith(".")}  # Hadoop leaves checksums beside files
    names = lambda f: sorted(r.qname for r in readers.alignments(spark, f"{out}/locusmill-{f}").collect())
    assert names("tmp_tele.bam") == ["r1", "r2", "r3", "r3", "r5"] and names("other.bam") == ["r4", "r6", "r7", "r8", "r9"]
    updated = {(r.qname, r.ref): r for r in readers.alignments(spark, f"{out}/locusmill-updated.bam").collect()}
    assert updated["r2", "chr1"].tags["ZF"] == "L1" and updated["r2", "chr1"].flag == 0 and "YC" in updated["r3", "chr2"].tags
    stats = open(f"{out}/locusmill-stats.final.tsv").read().splitlines()
    for want in ("alignments\t\ttotal_fragments\t9", "alignments\t\tloc_unique\t3", "alignments\t\tloc_ambig\t1", "molecules\t\texcluded\t1", "molecules\tcomponents\t1\t1", "reassign\tbest_exclude\tassigned\t3", "options\t\tseed\t5"):
        assert want in stats
    assert "9.0 fragments" in open(log).read() or "9 fragments" in open(log).read()
    main(["resume", f"{out}/locusmill-checkpoint.final", "--reassign_mode", "initial_unique", "--quiet", "--logfile", log], spark)
    assert os.path.exists(f"{out}/resumed-TE_counts.mtx")
    f = [f"{out}/locusmill-{n}" for n in ("TE_counts.mtx", "features.tsv", "barcodes.tsv")]
    main(["merge", *f, *f, "--outdir", out], spark)
    m = readers.matrix_market(spark, f"{out}/locusmill-merged_counts.mtx")
    assert sum(r.value for r in m.collect()) == 6 and len(open(f"{out}/locusmill-merged_features.tsv").read().split()) == 8
    main(["cellsort", str(inputs / "a.sam"), str(inputs / "bc.tsv"), "--outfile", f"{out}/sorted.bam"], spark)
    assert [r.qname for r in readers.bam(spark, f"{out}/sorted.bam").orderBy("file_seq").collect()] == ["r1", "r2", "r3", "r3", "r4", "r5", "r8"]
    with pytest.raises(SystemExit):
        main(["assign", "a", "b", "--reassign_mode", "nonsense"], spark)
    with pytest.raises(SystemExit):
        main(["assign", "--help"], spark)
    assert "Model parameters" in capsys.readouterr().out


def test_assign_resume_merge(spark, inputs):
    o = AssignOptions(str(inputs / "a.sam"), str(inputs / "a.gtf"), str(inputs / "bc.tsv"), str(inputs / "ct.tsv"), str(inputs / "out"), use_every_reassign_mode=True, updated_sam=True)
    out = pipeline.assign(spark, o)
    status = {r.status: r.n for r in out["status"].groupBy("status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert status == {"ok": 4, "no overlap": 1, "missing CB": 1, "CB not listed": 1, "missing UB": 1, "unmapped": 1}
    assert {r.qname for r in out["reads"].collect()} == {"r1", "r2", "r3", "r5"}
    names = {r.rid: r.qname for r in out["reads"].collect()}
    assert {names[r.rid] for r in out["corrected"].select("rid").distinct().collect()} == {"r2", "r3", "r5"}
    m = readers.matrix_market(spark, str(inputs / "out" / "locusmill-TE_counts.mtx"))
    assert sum(r.value for r in m.collect()) == 3
    assert (inputs / "out" / "locusmill-features.tsv").read_text().split() == ["__no_feature", "L1", "L2", "L3"]
    assert (inputs / "out" / "locusmill-barcodes.tsv").read_text().split() == ["AAAA", "CCCC"]
    assert "reassign\tbest_exclude\tassigned\t3" in (inputs / "out" / "locusmill-stats.final.tsv").read_text()
    assert readers.bam(spark, str(inputs / "out" / "locusmill-updated.bam")).count() == 5
    again = pipeline.resume(spark, str(inputs / "out" / "locusmill-checkpoint.final"), pooling_mode="celltype", outdir=str(inputs / "out2"), reassign_mode=("total_hits",), updated_sam=False)
    assert {r.pool for r in again["params"].select("pool").distinct().collect()} == {"T", "B"}
    f = [str(inputs / "out" / f"locusmill-{n}") for n in ("TE_counts.mtx", "features.tsv", "barcodes.tsv")]
    counts, feats, cells = pipeline.merge(spark, tuple(f), tuple(f))
    assert counts.count() == 2 * m.count() and feats.count() == 8


def test_tracking_and_cellsort(spark, inputs):
    o = AssignOptions(str(inputs / "a.sam"), str(inputs / "a.gtf"), outdir=str(inputs / "out"), skip_em=True, seed=1)
    out = pipeline.assign(spark, o)
    path = str(inputs / "umi.txt")
    sinks.umi_tracking(out["components"], out["representatives"], out["scores"], out["reads"].select("rid", "qname"), path)
    back = readers.umi_tracking(spark, path).orderBy("qname").collect()
    assert [(r.bc, r.umi, r.qname, r.status) for r in back] == [("AAAA", "G1", "r1", "EX"), ("AAAA", "G1", "r2", "REP")]
    pipeline.cellsort(spark, str(inputs / "a.sam"), str(inputs / "bc.tsv"), str(inputs / "sorted"))
    got = [r.value.split("\t")[0] for r in spark.read.text(str(inputs / "sorted")).collect()]
    assert sorted(got) == ["r1", "r2", "r3", "r3", "r4", "r5", "r8"]


def test_options(inputs):
    for bad in ({"pooling_mode": "x"}, {"conf_prob": 0.5}, {"reassign_mode": ("x",)}, {"stranded_mode": "Q"}, {"pooling_mode": "celltype"}):
        with pytest.raises(ValueError):
            AssignOptions(**bad)
    with pytest.raises(NotImplementedError):
        AssignOptions(overlap_mode="union")
