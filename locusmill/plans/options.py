"""Options of a run, checked, and rendered as rows."""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from locusmill.operators.reassign import ALIASES, MODES
from locusmill.sources.files import head

POOLING = ("pseudobulk", "individual", "celltype")
STRANDED = (None, "RF", "R", "FR", "F")


@dataclass(frozen=True)
class AssignOptions:
    alignments: str = ""
    annotation: str = ""
    filtered_bc: str | None = None
    celltype_tsv: str | None = None
    outdir: str = "."
    annotation_class: str = "intervaltree"
    exp_tag: str = "locusmill"
    barcode_tag: str = "CB"
    umi_tag: str = "UB"
    attribute: str = "locus"
    feature_type: str = "exon"
    no_feature_key: str = "__no_feature"
    stranded_mode: str | None = None
    overlap_mode: str = "threshold"
    overlap_threshold: float = 0.2
    pooling_mode: str = "pseudobulk"
    reassign_mode: tuple[str, ...] = ("best_exclude",)
    use_every_reassign_mode: bool = False
    conf_prob: float = 0.9
    ignore_umi: bool = False
    umi_counts: bool = False
    skip_em: bool = False
    updated_sam: bool = False
    pi_prior: float = 0.0
    theta_prior: float = 200_000.0
    em_epsilon: float = 1e-7
    max_iter: int = 100
    use_likelihood: bool = False
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.pooling_mode not in POOLING:
            raise ValueError(f"pooling_mode is one of {POOLING}")
        if self.pooling_mode == "celltype" and not self.celltype_tsv:
            raise ValueError("pooling by cell type needs celltype_tsv")
        if self.stranded_mode not in STRANDED:
            raise ValueError(f"stranded_mode is one of {STRANDED}")
        if self.annotation_class not in ("intervaltree", "htseq"):
            raise ValueError(f"unknown annotation class {self.annotation_class}")
        if self.overlap_mode != "threshold":
            raise NotImplementedError(f"overlap mode {self.overlap_mode}")
        if not 0.5 < self.conf_prob <= 1:
            raise ValueError("conf_prob is above 0.5 and at most 1")
        modes = tuple(ALIASES.get(m, m) for m in self.reassign_mode)
        if self.use_every_reassign_mode:
            modes = (*modes, *(m for m in MODES if m not in modes))
        if bad := [m for m in modes if m not in MODES]:
            raise ValueError(f"unknown modes {bad}")
        object.__setattr__(self, "reassign_mode", modes)

    def outfile(self, suffix: str) -> str:
        return os.path.join(self.outdir, f"{self.exp_tag}-{suffix}")


def resumed(saved: dict, given: dict) -> AssignOptions:
    """Options of a resumed run: what is given now, else what was saved; the reserved name stays."""
    names = {f.name for f in fields(AssignOptions)}
    out = {k: v for k, v in saved.items() if k in names} | {k: v for k, v in given.items() if k in names and v is not None}
    out["no_feature_key"] = saved.get("no_feature_key", AssignOptions.no_feature_key)
    out["reassign_mode"] = tuple(out.get("reassign_mode", ("best_exclude",)))
    return AssignOptions(**out)


def checksum_head(path: str, algorithm: str = "sha1", most: int = 1 << 20, spark: SparkSession | None = None) -> str:
    """Digest of a file's first bytes."""
    return hashlib.new(algorithm, head(spark, path, most)).hexdigest()


def derived_seed(options: AssignOptions, spark: SparkSession | None = None) -> int:
    """The given seed; -1: fresh entropy; none: from the digests of the two inputs."""
    if options.seed == -1:
        return int.from_bytes(os.urandom(4), "big")
    if options.seed is not None:
        return options.seed
    a, b = (int(checksum_head(p, spark=spark)[:7], 16) for p in (options.alignments, options.annotation))
    return a * b % (2**32 - 1)


def option_rows(spark: SparkSession, options: AssignOptions) -> DataFrame:
    """(stage, mode, var, value) of every option."""
    return spark.createDataFrame([("options", "", k, "" if v is None else str(v)) for k, v in asdict(options).items()], "stage string, mode string, var string, value string")


def with_options(options: AssignOptions, **changes) -> AssignOptions:
    return replace(options, **changes)
