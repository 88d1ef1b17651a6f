"""Rounding to decimal places on the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1, splits a double into halves whose products are exact


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def exact_round(x: Column, digits: int = 2) -> Column:
    """Round a non-negative double as correctly rounding decimal conversion does."""
    scale = float(10**digits)

    def of(v: Column) -> Column:
        c = v * F.lit(_SPLIT)
        return let(F.struct(v.alias("x"), (v * F.lit(scale)).alias("p"), (c - (c - v)).alias("hi")), parts)

    def parts(s: Column) -> Column:
        rest = (s["hi"] * F.lit(scale) - s["p"]) + (s["x"] - s["hi"]) * F.lit(scale)
        return let(F.struct(F.floor(s["p"]).cast("double").alias("f"), (s["p"] - F.floor(s["p"])).alias("d"), rest.alias("e")), final)

    def final(s: Column) -> Column:
        up = (s["d"] > 0.5) | ((s["d"] == 0.5) & ((s["e"] > 0) | ((s["e"] == 0) & (s["f"] % 2 == 1))))
        return (s["f"] + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)

    return let(x.cast("double"), of)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
