"""Metrics at four levels, as expressions, and the registry that holds them.

A metric's value is a Column over its level's table: a hunk's or a move's columns, an aggregate over a file's hunks, or an
aggregate over one of a diff's tables of results. Values of registered metrics are columns named like the metric, so a
later expression refers to them by ``metric(name)``. Adding a metric of a known name replaces it in its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hunkwise.config import Config
from hunkwise.functions.numeric import exact_round, ratio

INTEGER, FLOAT, RATIO = "integer", "float", "ratio"


def metric(name: str) -> Column:
    """The (rounded) value of a registered metric."""
    return F.col(f"`{name}`")


def raw(name: str) -> Column:
    """The value before rounding."""
    return F.col(f"`raw:{name}`")


@dataclass(frozen=True)
class Metric:
    """``value(config)`` gives the value. ``remedied``, over the raw value, says when the remediation is attached (None: never)."""

    name: str
    value_type: str
    value: Callable[[Config], Column]
    remediation: str | None = None
    remedied: Callable[[Column], Column] | None = None
    description: str = ""

    def rounded(self, value: Column) -> Column:
        return value if self.value_type == INTEGER else exact_round(value, 2)


class HunkMetric(Metric):
    """Over the columns of a hunk."""


class FileMetric(Metric):
    """An aggregate over the hunks of a file (null for a file without hunks counts as 0)."""


class MoveMetric(Metric):
    """Over the columns of a move."""


@dataclass(frozen=True)
class OverallMetric(Metric):
    """An aggregate over a diff's ``over``: hunks (those in no move), files or moves. ``empty`` is the value without rows."""

    over: str = "hunks"
    empty: float = 0
    digits: int = 2

    def rounded(self, value: Column) -> Column:
        return value if self.value_type == INTEGER else exact_round(exact_round(value, 4), 2) if self.digits == 4 else exact_round(value, 2)


class Registry:
    """Metrics by level in order of registration."""

    def __init__(self) -> None:
        self._levels: dict[type, dict[str, Metric]] = {HunkMetric: {}, FileMetric: {}, MoveMetric: {}, OverallMetric: {}}

    def add(self, added: Metric) -> None:
        for kind, known in self._levels.items():
            if isinstance(added, kind):
                known[added.name] = added
                return
        raise TypeError(f"{type(added).__name__} is not a metric of any level")

    def hunk_metrics(self) -> list[Metric]:
        return list(self._levels[HunkMetric].values())

    def file_metrics(self) -> list[Metric]:
        return list(self._levels[FileMetric].values())

    def move_metrics(self) -> list[Metric]:
        return list(self._levels[MoveMetric].values())

    def overall_metrics(self) -> list[Metric]:
        return list(self._levels[OverallMetric].values())


def interleaving(order: Column) -> Column:
    """How much a sequence alternates: changes of kind over their largest number; 0 for under four lines."""
    n = F.size(order)
    switches = F.aggregate(F.sequence(F.lit(2), n), F.lit(0), lambda k, i: k + F.when(F.element_at(order, i) != F.element_at(order, i - 1), 1).otherwise(0))
    return F.when(n < 4, F.lit(0.0)).otherwise(switches.cast("double") / (n - 1))


def edit_complexity(config: Config) -> Column:
    penalty = (F.lit(1.0) + F.lit(float(config.move_similarity_penalty)) * (F.lit(1.0) - F.col("similarity"))) / F.lit(config.max_move_lines)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.col("length") * penalty)


def scatter(_: Config) -> Column:
    """Entropy of the changed lines over files, relative to its largest value; added up in file order."""
    files = F.array_sort(F.collect_list(F.struct("file_idx", metric("file.lines_changed").alias("c"))))
    counts = F.transform(F.filter(files, lambda f: f["c"] > 0), lambda f: f["c"].cast("double"))
    total = F.sum(metric("file.lines_changed")).cast("double")
    entropy = -F.aggregate(counts, F.lit(0.0), lambda s, c: s + (c / total) * F.log2(c / total))
    return F.when((F.count("*") <= 1) | (total == 0) | (F.size(counts) < 2), F.lit(0.0)).otherwise(entropy / F.log2(F.size(counts).cast("double")))


def mean_interleaving(_: Config) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("hunk_idx", metric("hunk.interleaving").alias("x"), F.greatest(metric("hunk.lines_changed"), F.lit(1)).cast("double").alias("w"))))
    top = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["x"] * r["w"])
    return ratio(top, F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["w"]))


_ALWAYS = lambda v: F.lit(True)


def default_registry(config: Config) -> Registry:
    """The standard metrics. Their texts are part of the results (fixed values)."""
    found = Registry()
    count = lambda name: lambda _: F.col(name).cast("long")
    total = lambda name: lambda _: F.coalesce(F.sum(metric(name)), F.lit(0)).cast("long")
    under = lambda limit, more=None: lambda _: F.count_if((F.col("score") < F.lit(float(limit))) & (F.lit(True) if more is None else more()))
    for m in (
        HunkMetric("hunk.lines_changed", INTEGER, lambda _: (F.col("added_count") + F.col("removed_count")).cast("long")),
        HunkMetric("hunk.added_lines", INTEGER, count("added_count")),
        HunkMetric("hunk.removed_lines", INTEGER, count("removed_count")),
        HunkMetric("hunk.context_lines", INTEGER, count("context_count")),
        HunkMetric(
            "hunk.change_balance", RATIO, lambda _: ratio(F.col("added_count"), F.col("added_count") + F.col("removed_count")),
            "This hunk mixes deletions and additions together, making it hard to follow. "
            "Split into two separate commits: one that removes the old code, one that adds the new.", _ALWAYS,
        ),
        HunkMetric(
            "hunk.interleaving", RATIO, lambda _: interleaving(F.col("change_order")),
            "Additions and deletions are heavily interleaved, making the change hard to follow. "
            "Separate the deletions and additions into distinct commits or hunks.", lambda v: v > 0.0,
        ),
        FileMetric("file.lines_changed", INTEGER, lambda _: F.sum(F.col("added_count") + F.col("removed_count")).cast("long")),
        MoveMetric(
            "move.edit_complexity", RATIO, edit_complexity,
            "Consider splitting the change into focused commits: "
            "separate moves from logic changes, and rewrite large blocks incrementally.", _ALWAYS,
        ),
        OverallMetric("overall.files_changed", INTEGER, lambda _: F.count("*"), "Split the change into smaller pull requests by concern.", _ALWAYS, over="files"),
        OverallMetric("overall.lines_changed", INTEGER, total("hunk.lines_changed"), "Reduce patch size by splitting unrelated changes into separate commits.", _ALWAYS),
        OverallMetric("overall.added_lines", INTEGER, total("hunk.added_lines"), "Keep additions under 400 lines per review session.", _ALWAYS),
        OverallMetric("overall.problematic_hunk_count", INTEGER, under(config.hunk_score_threshold), "Simplify or split the hunks that score low.", _ALWAYS),
        OverallMetric("overall.problematic_move_count", INTEGER, under(config.hunk_score_threshold), "Simplify or split the moves that score low.", _ALWAYS, over="moves"),
        OverallMetric("overall.problematic_file_count", INTEGER, under(config.file_score_threshold, lambda: F.col("hunk_count") > 1), "Simplify or split the files that score low.", _ALWAYS, over="files"),
        OverallMetric("overall.scatter_factor", RATIO, scatter, over="files"),
        OverallMetric(
            "overall.mean_interleaving", RATIO, mean_interleaving,
            "Many hunks have heavily interleaved additions and deletions. Separate deletions and additions into focused commits.", lambda v: v > 0.1, digits=4,
        ),
    ):
        found.add(m)
    return found
