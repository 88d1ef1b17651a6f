"""The whole analysis of many diffs, as lazily evaluated tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.config import Config
from hunkwise.functions.numeric import exact_round
from hunkwise.operators import hunks as hunk_ops
from hunkwise.operators import moves as move_ops
from hunkwise.operators import rules as rule_ops
from hunkwise.operators.metrics import Metric, Registry, default_registry, metric, raw
from hunkwise.operators.rules import Rule
from hunkwise.operators.scoring import Scorer, WeightedScorer


@dataclass
class Analysis:
    """``hunks`` holds all hunks with their type; the analyses hold metrics and scores, hunk_analysis those in no move.

    ``stored`` are the tables that were kept; ``release`` lets go of them. Whatever is read afterwards is computed anew.
    """

    config: Config
    diffs: DataFrame
    files: DataFrame
    hunks: DataFrame
    pairs: DataFrame
    moves: DataFrame
    hunk_analysis: DataFrame
    file_analysis: DataFrame
    move_analysis: DataFrame
    overall: DataFrame
    levels: Registry
    stored: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for table in self.stored:
            table.unpersist()
        self.stored.clear()


def measured(df: DataFrame, metrics: list[Metric], config: Config) -> DataFrame:
    """``df`` with every metric's raw and rounded value."""
    for m in metrics:
        df = df.withColumn(f"raw:{m.name}", m.value(config))
        df = df.withColumn(m.name, m.rounded(raw(m.name)))
    return df


def metric_list(metrics: list[Metric]) -> Column:
    """A row's metrics as an array in order of registration."""
    kind = "array<struct<name:string,value:double,value_type:string,remediation:string>>"
    each = []
    for m in metrics:
        remedy = F.lit(None).cast("string") if m.remediation is None or m.remedied is None else F.when(m.remedied(raw(m.name)), F.lit(m.remediation))
        each.append(F.struct(F.lit(m.name).alias("name"), metric(m.name).cast("double").alias("value"), F.lit(m.value_type).alias("value_type"), remedy.alias("remediation")))
    return F.array(*each).cast(kind)


def analyse(lines: DataFrame, files: DataFrame, config: Config, diffs: DataFrame | None = None, registry: Registry | None = None, scorer: Scorer | None = None, keep: bool = True) -> Analysis:
    """Builds all tables. ``keep`` stores those that several others read, in memory and on disk, until ``release``."""
    levels = registry or default_registry(config)
    score = scorer or WeightedScorer(config)
    kept: list[DataFrame] = []

    def stored(df: DataFrame) -> DataFrame:
        if keep:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    built = stored(hunk_ops.build_hunks(hunk_ops.filter_lines(lines, config)))
    pairs = move_ops.pair_similarity(built)
    moves = stored(move_ops.match_hunks(pairs, built))
    typed = move_ops.typed_hunks(built, moves)

    def names(metrics: list[Metric]) -> set[str]:
        return {m.name for m in metrics}

    hm, fm, mm, om = levels.hunk_metrics(), levels.file_metrics(), levels.move_metrics(), levels.overall_metrics()
    # metrics read a hunk's lines, what follows doesn't, so lines are not stored again
    alone = measured(typed.where(~F.col("in_move")), hm, config).drop("added", "removed", "added_occ", "removed_occ", "context", "change_order")
    alone = stored(alone.withColumn("score", score.hunk(names(hm))).withColumn("metrics", metric_list(hm)))
    moved = stored(measured(moves, mm, config).withColumn("score", score.move(names(mm))).withColumn("metrics", metric_list(mm)))

    by_file = built.groupBy("diff_id", "file_idx").agg(F.count("*").alias("hunk_count"), *[m.value(config).alias(f"raw:{m.name}") for m in fm])
    per_file = files.join(by_file, ["diff_id", "file_idx"], "left").withColumn("hunk_count", F.coalesce("hunk_count", F.lit(0)))
    for m in fm:
        per_file = per_file.withColumn(f"raw:{m.name}", F.coalesce(raw(m.name), F.lit(0))).withColumn(m.name, m.rounded(raw(m.name)))
    per_file = stored(per_file.withColumn("score", score.file(names(fm))).withColumn("metrics", metric_list(fm)))

    base = diffs if diffs is not None else files.select("diff_id").distinct()
    overall = base
    for over, rows in (("files", per_file), ("hunks", alone), ("moves", moved)):
        mine = [m for m in om if m.over == over]
        if mine:
            overall = overall.join(rows.groupBy("diff_id").agg(*[m.value(config).alias(f"raw:{m.name}") for m in mine]), "diff_id", "left")
    for m in om:
        none = F.lit(int(m.empty) if m.value_type == "integer" else float(m.empty))
        overall = overall.withColumn(f"raw:{m.name}", F.coalesce(raw(m.name), none)).withColumn(m.name, m.rounded(raw(m.name)))
    overall = stored(overall.withColumn("score", score.overall(names(om))).withColumn("metrics", metric_list(om)))
    return Analysis(config, base, files, typed, pairs, moves, alone, per_file, moved, overall, levels, kept)


def violations(a: Analysis, hunk_rules: list[Rule] | None = None, overall_rules: list[Rule] | None = None) -> DataFrame:
    """``diff_id, section, subject, ord, severity, message, text``: hunk violations (section 0), then the diff's (1)."""
    hr = rule_ops.hunk_rules(a.config) if hunk_rules is None else hunk_rules
    orr = rule_ops.overall_rules(a.config) if overall_rules is None else overall_rules
    of_hunks = a.hunk_analysis.select("diff_id", F.lit(0).alias("section"), F.col("hunk_idx").alias("subject"), F.posexplode(rule_ops.evaluate(hr)).alias("ord", "v"))
    of_diffs = a.overall.select("diff_id", F.lit(1).alias("section"), F.lit(0).alias("subject"), F.posexplode(rule_ops.evaluate(orr)).alias("ord", "v"))
    return of_hunks.unionByName(of_diffs).select("diff_id", "section", "subject", "ord", "v.severity", "v.message", rule_ops.text(F.col("v")).alias("text"))


#: Sections of a report's entries, in the order in which they are listed.
HUNK_RULE, DIFF_RULE, OVERALL, FILE, MOVE, HUNK, HUNK_ADVICE, MOVE_ADVICE, DIFF_ADVICE = range(9)
_ENTRY = "struct<section:int,subject:int,ord:int,text:string,error:boolean,value:double,number:int,values:array<double>>"


def _entry(section: int, subject: Column, ord_: Column | None = None, text: Column | None = None, error: Column | None = None, value: Column | None = None, number: Column | None = None, values: Column | None = None) -> Column:
    fields = {"section": F.lit(section), "subject": subject, "ord": ord_, "text": text, "error": error, "value": value, "number": number, "values": values}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in fields.items()]).cast(_ENTRY)


def _rules(a: Analysis) -> DataFrame:
    found = violations(a)
    entry = lambda section: _entry(section, F.col("subject"), F.col("ord"), F.col("text"), F.col("severity") == rule_ops.ERROR)
    return found.select("diff_id", F.when(F.col("section") == 0, entry(HUNK_RULE)).otherwise(entry(DIFF_RULE)).alias("e"))


def _scores(a: Analysis) -> DataFrame:
    return a.overall.select("diff_id", _entry(OVERALL, F.lit(0), value=F.col("score"), values=_values(a.levels.overall_metrics())).alias("e"))


def _values(metrics: list[Metric]) -> Column:
    return F.array(*[metric(m.name).cast("double") for m in metrics]).cast("array<double>")


def _advice(a: Analysis) -> DataFrame:
    """What could be recommended, whether or not the diff passes: low hunks, low moves, then overall."""
    low = F.col("score") < F.lit(float(a.config.hunk_score_threshold))

    def part(rows: DataFrame, section: int, subject: Column, location: Column) -> DataFrame:
        each = rows.select("diff_id", subject.alias("subject"), location.alias("location"), F.posexplode("metrics").alias("ord", "m")).where("m.remediation is not null")
        return each.select("diff_id", _entry(section, F.col("subject"), F.col("ord"), F.col("location"), value=F.col("m.value"), number=F.col("ord")).alias("e"))

    found = part(a.hunk_analysis.where(low), HUNK_ADVICE, F.col("hunk_idx"), F.col("file_path"))
    found = found.unionByName(part(a.move_analysis.where(low), MOVE_ADVICE, F.col("i"), F.concat(F.lit("move:"), F.col("move_id").cast("string"))))
    return found.unionByName(part(a.overall, DIFF_ADVICE, F.lit(0), F.lit("overall")))


def _levels(a: Analysis) -> DataFrame:
    """An entry for each file, move and hunk."""
    short = exact_round(F.col("score"), 2)
    files = a.file_analysis.select("diff_id", _entry(FILE, F.col("file_idx"), text=F.col("path"), value=short, values=_values(a.levels.file_metrics())).alias("e"))
    moves = a.move_analysis.select("diff_id", _entry(MOVE, F.col("i"), value=short, number=F.col("move_id"), values=_values(a.levels.move_metrics())).alias("e"))
    hunks = a.hunk_analysis.select("diff_id", _entry(HUNK, F.col("hunk_idx"), text=F.col("file_path"), value=short, values=_values(a.levels.hunk_metrics())).alias("e"))
    return files.unionByName(moves).unionByName(hunks)


def _collected(*parts: DataFrame) -> DataFrame:
    """``diff_id, e, failed``: each diff's entries in order. One grouping, and no join, whatever the parts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("diff_id").agg(F.array_sort(F.collect_list("e")).alias("e"), F.coalesce(F.max(F.col("e.error")), F.lit(False)).alias("failed"))


def _of(*sections: int) -> Column:
    return F.filter("e", lambda x: x["section"].isin(*sections))


def _gated(collected: DataFrame) -> DataFrame:
    texts = F.transform(_of(HUNK_RULE, DIFF_RULE), lambda x: x["text"])
    return collected.withColumns({"score": F.get(_of(OVERALL), 0)["value"], "passed": ~F.col("failed"), "violations": texts})


def gate(a: Analysis) -> DataFrame:
    """``diff_id, score, passed, violations``: a diff passes unless a violation is an error."""
    return _gated(_collected(_rules(a), _scores(a))).select("diff_id", "score", "passed", "violations")


def _texts(a: Analysis) -> Column:
    """Name, type and remediation of the metrics of hunks, moves and diffs, in the order of their advice's sections."""
    kind = "array<struct<name:string,value_type:string,remediation:string>>"
    each = [[F.struct(F.lit(m.name).alias("name"), F.lit(m.value_type).alias("value_type"), F.lit(m.remediation).cast("string").alias("remediation")) for m in level] for level in (a.levels.hunk_metrics(), a.levels.move_metrics(), a.levels.overall_metrics())]
    return F.array(*[F.array(*level).cast(kind) for level in each])


def recommendations(a: Analysis) -> DataFrame:
    """For failed diffs: low hunks, low moves, then overall; ``diff_id, section, subject, ord, location, metric, value, value_type, remediation``."""
    rows = _collected(_rules(a), _advice(a)).where("failed").select("diff_id", F.explode(_of(HUNK_ADVICE, MOVE_ADVICE, DIFF_ADVICE)).alias("x"))
    section = F.col("x.section") - HUNK_ADVICE
    named = rows.select("diff_id", "x", section.alias("section"), F.get(F.get(_texts(a), section), F.col("x.number")).alias("m"))
    return named.select("diff_id", "section", "x.subject", "x.ord", F.col("x.text").alias("location"), F.col("m.name").alias("metric"), "x.value", "m.value_type", "m.remediation")


def report(a: Analysis, detailed: bool = False) -> DataFrame:
    """One row per diff: ``diff_id, score, passed, violations, recommendations`` and, if detailed, all levels."""
    parts = [_rules(a), _scores(a), _advice(a), *([_levels(a)] if detailed else [])]
    gated = _gated(_collected(*parts)).withColumn("m", _texts(a))
    kind = "array<struct<location:string,metric:string,value:double,value_type:string,remediation:string>>"

    def advice(x: Column) -> Column:
        m = F.get(F.get("m", x["section"] - HUNK_ADVICE), x["number"])
        return F.struct(x["text"].alias("location"), m["name"].alias("metric"), x["value"].alias("value"), m["value_type"].alias("value_type"), m["remediation"].alias("remediation"))

    listed = F.when(F.col("failed"), F.transform(_of(HUNK_ADVICE, MOVE_ADVICE, DIFF_ADVICE), advice)).otherwise(F.array()).cast(kind)
    out = ["diff_id", exact_round(F.col("score"), 2).alias("score"), "passed", "violations", listed.alias("recommendations")]
    if not detailed:
        return gated.select(*out)

    def metrics(values: Column, level: list[Metric]) -> Column:
        names = F.array(*[F.struct(F.lit(m.name).alias("name"), F.lit(m.value_type).alias("value_type")) for m in level]).cast("array<struct<name:string,value_type:string>>")
        return F.zip_with(names, values, lambda n, v: F.struct(n["name"].alias("name"), v.alias("value"), n["value_type"].alias("value_type")))

    fm, mm, hm, om = a.levels.file_metrics(), a.levels.move_metrics(), a.levels.hunk_metrics(), a.levels.overall_metrics()
    levels = {
        "overall": metrics(F.get(_of(OVERALL), 0)["values"], om),
        "files": F.transform(_of(FILE), lambda x: F.struct(x["text"].alias("file"), x["value"].alias("score"), metrics(x["values"], fm).alias("metrics"))),
        "moves": F.transform(_of(MOVE), lambda x: F.struct(x["number"].alias("move_id"), F.lit(2).alias("hunk_count"), x["value"].alias("score"), metrics(x["values"], mm).alias("metrics"))),
        "hunks": F.transform(_of(HUNK), lambda x: F.struct(x["text"].alias("file"), x["value"].alias("score"), metrics(x["values"], hm).alias("metrics"))),
    }
    counts = [F.size(_of(FILE)).alias("files_changed"), F.size(_of(HUNK)).alias("hunks_changed")]
    return gated.select(*out, *[v.alias(k) for k, v in levels.items()], *counts)
