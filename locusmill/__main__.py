"""The command line: python -m locusmill assign | resume | merge | cellsort."""

from __future__ import annotations

import os
import sys
from argparse import Namespace
from collections.abc import Callable

from pyspark.sql import SparkSession

from locusmill.plans import logs, pipeline, schema
from locusmill.plans.options import AssignOptions
from locusmill.scratch import sweep
from locusmill.session import local_session

VERSION = "0.2"


def session(args: Namespace) -> SparkSession:
    """The session that a cluster's launcher gives, else a local one of nproc cores."""
    active = SparkSession.getActiveSession()
    if active is not None or os.environ.get("SPARK_ENV_LOADED") or "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        spark = active or SparkSession.builder.appName("locusmill").getOrCreate()
    else:
        spark = local_session(max(1, getattr(args, "nproc", 1) or 1))
    if getattr(args, "tempdir", None) and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", args.tempdir)
    return spark


def assign(spark: SparkSession, args: Namespace) -> None:
    pipeline.assign(spark, AssignOptions(**schema.fields_of("assign", args)))


def resume(spark: SparkSession, args: Namespace) -> None:
    given = schema.fields_of("resume", args)
    if given.get("outdir") is None:
        given["outdir"] = os.path.dirname(args.checkpoint.rstrip("/")) or "."
    pipeline.resume(spark, args.checkpoint, **given)


def merge(spark: SparkSession, args: Namespace) -> None:
    a, b = ((getattr(args, f"{k}_counts"), getattr(args, f"{k}_features"), getattr(args, f"{k}_barcodes")) for k in ("gene", "TE"))
    pipeline.merge_files(spark, a, b, args.outdir, args.exp_tag)


def cellsort(spark: SparkSession, args: Namespace) -> None:
    pipeline.cellsort(spark, args.infile, args.filtered_bc, args.outfile)


COMMANDS: dict[str, Callable[[SparkSession, Namespace], None]] = {"assign": assign, "resume": resume, "merge": merge, "cellsort": cellsort}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = schema.parser(version=VERSION).parse_args(argv)
    logs.configure(getattr(args, "quiet", False), getattr(args, "debug", False), getattr(args, "verbose", None), args.logfile)
    spark = spark or session(args)
    COMMANDS[args.command](spark, args)
    sweep(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
