"""Reports as JSON text: integers without a fraction, ratios with one, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(s: Column) -> Column:
    """A string as a JSON string, null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(s.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1), F.lit("null")) if s is not None else F.lit("null")


def number(value: Column, value_type: Column) -> Column:
    return F.when(value_type == "integer", value.cast("long").cast("string")).otherwise(value.cast("string"))


def _object(**fields: Column) -> Column:
    parts = [x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(f'{"," if i else "{"}"{k}":'), v)]
    return F.concat(*parts, F.lit("}"))


def _list(items: Column, each) -> Column:  # noqa: ANN001
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, each), ","), F.lit("")), F.lit("]"))


def report_json(reports: DataFrame, detailed: bool = False) -> DataFrame:
    """``diff_id, json`` of ``plans.analysis.report``."""
    flag = F.when(F.col("passed"), F.lit("true")).otherwise(F.lit("false"))
    one = lambda m: _object(name=quoted(m["name"]), value=number(m["value"], m["value_type"]))
    fields = {
        "score": F.col("score").cast("string"),
        "passed": flag,
        "violations": _list(F.col("violations"), quoted),
        "recommendations": _list(F.col("recommendations"), lambda r: _object(location=quoted(r["location"]), metric=quoted(r["metric"]), value=number(r["value"], r["value_type"]), remediation=quoted(r["remediation"]))),
    }
    if detailed:
        fields |= {
            "files_changed": F.col("files_changed").cast("string"),
            "hunks_changed": F.col("hunks_changed").cast("string"),
            "overall": _list(F.col("overall"), one),
            "files": _list(F.col("files"), lambda f: _object(file=quoted(f["file"]), score=f["score"].cast("string"), metrics=_list(f["metrics"], one))),
            "moves": _list(F.col("moves"), lambda m: _object(move_id=m["move_id"].cast("string"), hunk_count=m["hunk_count"].cast("string"), score=m["score"].cast("string"), metrics=_list(m["metrics"], one))),
            "hunks": _list(F.col("hunks"), lambda h: _object(file=quoted(h["file"]), score=h["score"].cast("string"), metrics=_list(h["metrics"], one))),
        }
    return reports.select("diff_id", _object(**fields).alias("json"))
