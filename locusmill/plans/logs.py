"""Logging: where and how much, and summaries of a run in words."""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from time import monotonic

LOG = logging.getLogger("locusmill")


def human(n: float) -> str:
    """One decimal and an SI suffix."""
    for at, suffix in ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K")):
        if abs(n) >= at:
            return f"{n / at:.1f}{suffix}"
    return f"{n:.1f}"


def minutes(seconds: float) -> str:
    return f"{int(seconds) // 60} minutes and {int(seconds) % 60} secs"


def configure(quiet: bool = False, debug: bool = False, verbose: int | None = None, logfile: str | None = None) -> None:
    """Level and place of the log; verbose, where given, decides the level alone."""
    level = logging.DEBUG if debug else logging.WARNING if quiet else logging.INFO
    if verbose is not None:
        level = {0: logging.WARNING, 1: logging.INFO}.get(verbose, logging.DEBUG)
    handler = logging.FileHandler(logfile) if logfile else logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-8s %(message)s", "%Y-%m-%d %H:%M:%S"))
    for old in list(LOG.handlers):
        LOG.removeHandler(old)
        old.close()
    LOG.addHandler(handler)
    LOG.setLevel(level)
    LOG.propagate = False


@contextmanager
def stage(number: int, name: str) -> Iterator[None]:
    """Logs a stage's begin, and its end with the time that it took."""
    LOG.info("Stage %d: %s", number, name)
    began = monotonic()
    yield
    LOG.info("Stage %d done in %s", number, minutes(monotonic() - began))


def alignment_lines(s: Mapping) -> list[str]:
    mapped = s["total_fragments"] - s["unmapped"]
    return [
        f"{human(s['total_fragments'])} fragments: {s['paired']} paired, {s['single']} single, {s['unmapped']} not mapped",
        f"{mapped} mapped: {s['loc_unique'] + s['noloc_unique']} with one alignment, {s['loc_ambig'] + s['noloc_ambig']} with several",
        f"{s['loc_unique'] + s['loc_ambig']} on features: {s['loc_unique']} with one alignment, {s['loc_ambig']} with several",
        f"scores from {s['minAS']} to {s['maxAS']}",
    ]


def error_lines(errors: list[tuple[str, int]]) -> list[str]:
    """Reasons for which fragments were left out, the commonest first."""
    ordered = sorted(errors, key=lambda e: (-e[1], e[0]))
    return [f"{sum(n for _, n in ordered)} fragments left out", *(f"  {n}: {why}" for why, n in ordered)] if ordered else []


def umi_lines(s: Mapping, bins: list[tuple[str, int]], comps: list[tuple[int, int]]) -> list[str]:
    out = [f"{s['num_umi']} molecules: {s['unique']} with one read, {s['duplicated']} with several, {s['max_reads']} at most; {s['possible_duplicates']} possible duplicates"]
    out += [f"  molecules with {b} reads: {n}" for b, n in bins]
    out += [f"  molecules of {k} component{'s' if k > 1 else ''}: {n}" for k, n in comps if k <= 3]
    more = sum(n for k, n in comps if k > 3)
    return out + ([f"  molecules of more components: {more}"] if more else []) + [f"{s['excluded']} duplicate reads left out"]


def reassign_lines(s: Mapping) -> list[str]:
    return [f"{s['mode']}: {s['assigned']} assigned, {s['ambiguous']} ambiguous, {s['unaligned']} without a feature"]


def say(lines: list[str]) -> None:
    for line in lines:
        LOG.info("    %s", line)
