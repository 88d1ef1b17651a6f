"""Command line: analyse one diff, print its report, exit with 1 where the gate fails."""

from __future__ import annotations

import json
import sys
from argparse import ArgumentParser, Namespace
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from hunkwise.config import default_text, load_config
from hunkwise.plans.analysis import analyse, report
from hunkwise.plans.render import report_json
from hunkwise.sources.patches import PatchError, from_git, from_text, parse_diffs, split_parsed

#: What can be given, and what argparse makes of it.
OPTIONS = {
    ("git_args",): {"nargs": "*", "help": "what git diff compares; without any, the working tree"},
    ("--from-stdin",): {"action": "store_true", "help": "take a unified diff from standard input; git is not run"},
    ("--detailed",): {"action": "store_true", "help": "report every file, move and hunk too"},
    ("-c", "--config"): {"default": "hunkwise.toml", "help": "TOML file with limits and weights"},
    ("--print-default-config",): {"action": "store_true", "help": "print the default TOML file and stop"},
}


def options(argv: list[str] | None) -> Namespace:
    known = ArgumentParser(prog="hunkwise", description="Tells how hard a diff is to review.")
    for names, how in OPTIONS.items():
        known.add_argument(*names, **how)
    return known.parse_args(argv)


def analysed(source: DataFrame, config_path: str, detailed: bool) -> dict:
    """The report of the one diff in ``source``."""
    parsed = parse_diffs(source).persist()
    diffs, files, lines, errors = split_parsed(parsed)
    if broken := errors.head():
        raise PatchError(broken["parse_error"])
    tables = analyse(lines, files, load_config(config_path), diffs)
    try:
        return json.loads(report_json(report(tables, detailed), detailed).head()["json"])
    finally:
        tables.release()
        parsed.unpersist()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: TextIO | None = None) -> int:
    given = options(argv)
    if given.print_default_config:
        print(default_text(), end="")
        return 0
    spark = spark or SparkSession.builder.appName("hunkwise").getOrCreate()
    source = from_text(spark, (stdin or sys.stdin).read()) if given.from_stdin else from_git(spark, *given.git_args)
    found = analysed(source, given.config, given.detailed)
    print(json.dumps(found, indent=2))
    return int(not found["passed"])


if __name__ == "__main__":
    sys.exit(main())
