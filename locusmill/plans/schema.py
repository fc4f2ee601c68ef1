"""Commands and their options: a schema read from a file, as command-line arguments and as options of a run."""

from __future__ import annotations

import argparse
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

SCHEMA = Path(__file__).with_name("commands.toml")
KINDS = {"text": str, "whole": int, "number": float}


@dataclass(frozen=True)
class Option:
    name: str
    group: str
    kind: str = "text"
    default: object = None
    choices: tuple = ()
    place: bool = False
    short: str | None = None
    hide: bool = False
    field: str | None = None
    say: str = ""

    def checked_list(self, text: str) -> tuple[str, ...]:
        parts = tuple(p.strip() for p in text.split(",") if p.strip())
        if bad := [p for p in parts if self.choices and p not in self.choices]:
            raise argparse.ArgumentTypeError(f"{', '.join(bad)}: choose from {', '.join(self.choices)}")
        return parts

    def add_to(self, group) -> None:
        said = argparse.SUPPRESS if self.hide else self.say.replace("%", "%%")
        if self.place:
            group.add_argument(self.name, help=said)
            return
        names = [f"--{self.name}", *([self.short] if self.short else [])]
        if self.kind == "switch":
            group.add_argument(*names, action="store_true", help=said)
        elif self.kind == "count":
            group.add_argument(*names, action="count", default=self.default, help=said)
        elif self.kind == "list":
            group.add_argument(*names, type=self.checked_list, default=self.checked_list(str(self.default)), help=said)
        else:
            default = KINDS[self.kind](self.default) if self.default is not None else None
            group.add_argument(*names, type=KINDS[self.kind], default=default, choices=self.choices or None, help=said)


def commands(path: Path = SCHEMA) -> dict[str, tuple[str, list[Option]]]:
    """By command what it does and its options, in order."""
    tables = tomllib.loads(path.read_text())
    return {c: (groups["doc"]["say"], list(options(groups))) for c, groups in tables.items()}


def options(groups: dict) -> Iterator[Option]:
    for group, rows in groups.items():
        if group != "doc":
            for name, row in rows.items():
                yield Option(name, group, **{k: tuple(v) if k == "choices" else v for k, v in row.items()})


def parser(path: Path = SCHEMA, version: str = "") -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="locusmill", description="Counts of ambiguous fragments by feature and cell, on Spark")
    out.add_argument("--version", action="version", version=version)
    subs = out.add_subparsers(dest="command", required=True)
    for name, (say, opts) in commands(path).items():
        sub = subs.add_parser(name, description=say, help=say, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        groups: dict = {}
        for o in opts:
            if o.group not in groups:
                groups[o.group] = sub.add_argument_group(o.group)
            o.add_to(groups[o.group])
    return out


def fields_of(command: str, args: argparse.Namespace, path: Path = SCHEMA) -> dict:
    """What the command line gives for the options of a run, by their fields."""
    return {o.field or o.name: getattr(args, o.name) for o in commands(path)[command][1] if o.field != ""}
