"""Scores between 0 (hard to review) and 1, from metrics alone."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from hunkwise.config import Config

from .metrics import metric


class Scorer(Protocol):
    """Four expressions over the metrics of a level. ``names`` are those that the level has; a missing one scores 1."""

    def hunk(self, names: set[str]) -> Column: ...

    def file(self, names: set[str]) -> Column: ...

    def move(self, names: set[str]) -> Column: ...

    def overall(self, names: set[str]) -> Column: ...


class WeightedScorer:
    """1 less the share of the size limit used, amplified by interleaving."""

    def __init__(self, config: Config) -> None:
        self.config, self.weight = config, F.lit(float(config.weights.interleaving_weight))

    def _amplified(self, used: Column, names: set[str], name: str) -> Column:
        factor = F.lit(1.0) + self.weight * (metric(name) if name in names else F.lit(0.0))
        return F.greatest(F.lit(0.0), F.lit(1.0) - used * factor)

    def hunk(self, names: set[str]) -> Column:
        if "hunk.lines_changed" not in names:
            return F.lit(1.0)
        return self._amplified(metric("hunk.lines_changed").cast("double") / F.lit(self.config.max_hunk_lines), names, "hunk.interleaving")

    def file(self, names: set[str]) -> Column:
        if "file.lines_changed" not in names:
            return F.lit(1.0)
        return F.greatest(F.lit(0.0), F.lit(1.0) - metric("file.lines_changed").cast("double") / F.lit(self.config.max_diff_lines))

    def move(self, names: set[str]) -> Column:
        return metric("move.edit_complexity") if "move.edit_complexity" in names else F.lit(1.0)

    def overall(self, names: set[str]) -> Column:
        if "overall.lines_changed" not in names:
            return F.lit(1.0)
        used = F.least(metric("overall.lines_changed").cast("double") / F.lit(self.config.max_diff_lines), F.lit(1.0))
        return self._amplified(used, names, "overall.mean_interleaving")
