"""Threshold rules: a severity and an expression for the message, null where the rule holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hunkwise.config import Config
from hunkwise.functions.numeric import exact_round

from .metrics import metric

WARNING, ERROR = "warning", "error"


@dataclass(frozen=True)
class Rule:
    """``message`` is an expression over the level's row (its metrics and ``score``)."""

    severity: str
    message: Column


def _above(name: str, limit: float, before: str, after: str) -> Column:
    return F.when(metric(name) > F.lit(limit), F.concat(F.lit(before), metric(name).cast("string"), F.lit(f"{after}{limit}")))


def hunk_rules(config: Config) -> list[Rule]:
    """For hunks in no move. The texts of all rules are part of the results (fixed values)."""
    return [Rule(WARNING, _above("hunk.lines_changed", config.max_hunk_lines, "Hunk has ", " lines, exceeds limit of "))]


def overall_rules(config: Config) -> list[Rule]:
    """For whole diffs; an optional limit that isn't set makes no rule."""
    rules = [Rule(ERROR, _above("overall.lines_changed", config.max_diff_lines, "Diff has ", " lines changed, exceeds limit of "))]
    if config.min_overall_score is not None:
        shown = F.format_string("%.2f", exact_round(F.col("score"), 2))
        text = F.concat(F.lit("Overall score "), shown, F.lit(f" is below the minimum of {config.min_overall_score}"))
        rules.append(Rule(ERROR, F.when(F.col("score") < F.lit(float(config.min_overall_score)), text)))
    for limit, severity, name, before, after in (
        (config.max_problematic_hunks, WARNING, "overall.problematic_hunk_count", "Diff has ", " problematic hunks, exceeds limit of "),
        (config.max_problematic_moves, WARNING, "overall.problematic_move_count", "Diff has ", " problematic moves, exceeds limit of "),
        (config.max_problematic_files, WARNING, "overall.problematic_file_count", "Diff has ", " problematic files, exceeds limit of "),
        (config.max_files_changed, ERROR, "overall.files_changed", "Diff touches ", " files, exceeds limit of "),
        (config.max_added_lines, ERROR, "overall.added_lines", "Diff has ", " added lines, exceeds limit of "),
    ):
        if limit is not None:
            rules.append(Rule(severity, _above(name, limit, before, after)))
    return rules


def evaluate(rules: list[Rule]) -> Column:
    """The failing rules of a row, in rule order: array of struct(severity, message)."""
    kind = "array<struct<severity:string,message:string>>"
    if not rules:
        return F.array().cast(kind)
    each = [F.struct(F.lit(r.severity).alias("severity"), r.message.alias("message")) for r in rules]
    return F.filter(F.array(*each), lambda v: v["message"].isNotNull()).cast(kind)


def text(violation: Column) -> Column:
    return F.concat(F.lit("["), F.upper(violation["severity"]), F.lit("] "), violation["message"])
