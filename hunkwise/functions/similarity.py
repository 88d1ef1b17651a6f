"""Line similarity and greedy one-to-one matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a`` (Hyyro 2004)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def line_ratio(a: str, b: str) -> float:
    """Insertion-deletion similarity of two lines, 0 to 1."""
    n = len(a) + len(b)
    if not n:
        return 1.0
    return (1.0 - (n - 2 * common_subsequence(a, b)) / n) * 100.0 / 100.0


class LineMatcher:
    """One-to-one matches between two lists of lines, best first, from a similarity of ``least`` on.

    Equal similarities go by the first list's order, then the second's. Similarities of the last ``KNOWN`` pairs of texts
    are remembered.
    """

    KNOWN = 1 << 18

    def __init__(self, least: float) -> None:
        self.least = least
        self.known: dict[tuple[str, str], float] = {}

    def ratio(self, a: str, b: str) -> float:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            found = self.known[a, b] = line_ratio(a, b)
        return found

    def match(self, first: list[str], second: list[str]) -> tuple[int, float]:
        """Number of matches, and their similarities added up in order of acceptance."""
        pairs = []
        for i, a in enumerate(first):
            for j, b in enumerate(second):
                m, n = len(a), len(b)
                # no similarity is above 2 * min / (m + n)
                if 2.0 * min(m, n) >= self.least * (m + n) and (score := self.ratio(a, b)) >= self.least:
                    pairs.append((-score, i, j))
        pairs.sort()
        gone, come, total = set(), set(), 0.0
        for negative, i, j in pairs:
            if i not in gone and j not in come:
                gone.add(i)
                come.add(j)
                total -= negative
        return len(gone), total


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``line_ratio`` over Arrow batches; each distinct pair of a batch is computed once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = line_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def indel_ratio_sql(a: Column, b: Column) -> Column:
    """The same from built-in functions only: a dynamic programme over characters, for short lines."""
    chars = F.filter(F.split(b, ""), lambda c: c != "")

    def row(prev: Column, c: Column) -> Column:
        cells = F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(chars, j) == c, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(acc, j - 1))))),
        )
        return cells

    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    lcs = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, row, lambda r: F.element_at(r, -1))
    n = F.length(a) + F.length(b)
    ratio = (F.lit(1.0) - (n - F.lit(2) * lcs).cast("double") / n.cast("double")) * 100.0 / 100.0
    return F.when(n == 0, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(ratio)


def greedy_pairs(pairs: Column) -> Column:
    """One-to-one pairs out of ``pairs``, an array of struct(neg, i, j), best first: an item is in one pair at most.

    ``neg`` is the negated score; equal scores go by i, then j.
    """
    kind = "struct<used:array<int>,picked:array<struct<neg:double,i:int,j:int>>>"
    empty = F.struct(F.array().alias("used"), F.array().alias("picked")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["used"], p["i"]) & ~F.array_contains(s["used"], p["j"])
        more = F.struct(F.concat(s["used"], F.array(p["i"], p["j"])).alias("used"), F.concat(s["picked"], F.array(p)).alias("picked")).cast(kind)
        return F.when(free, more).otherwise(s)

    return F.aggregate(F.array_sort(pairs), empty, step, lambda s: s["picked"])
