"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.config import prefix_table
from hunkwise.functions import text as text_fn
from hunkwise.functions.numeric import exact_round
from hunkwise.functions.similarity import indel_ratio, indel_ratio_sql
from hunkwise.operators import hunks as H
from hunkwise.operators import metrics as M
from hunkwise.operators import moves as V
from hunkwise.plans import analysis as A
from hunkwise.plans.render import report_json
from hunkwise.sources import workloads as L
from hunkwise.sources.patches import parse_diffs, split_parsed

CONFIG = L.LINEITEM_CONFIG
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _millionths(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return H.filter_lines(L.lineitem_changes(spark, sf), CONFIG)


def _hunks(spark: SparkSession, sf: str) -> DataFrame:
    return H.build_hunks(_filtered(spark, sf))


_last: list[A.Analysis] = []


def _analysis(spark: SparkSession, sf: str, registry: M.Registry | None = None) -> A.Analysis:
    """The analysis of the orders; the tables that the one before it keeps are let go."""
    while _last:
        before = _last.pop()
        if before.overall.sparkSession is spark:
            before.release()
    lines = L.lineitem_changes(spark, sf)
    _last.append(A.analyse(lines, H.files_of(lines), CONFIG, registry=registry))
    return _last[0]


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return A.measured(_hunks(spark, sf), M.default_registry(CONFIG).hunk_metrics(), CONFIG)


@query
def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return L.lineitem_changes(spark, sf).groupBy("diff_id", "kind").agg(F.count("*").alias("n"))


@query
def line_normalise(spark: SparkSession, sf: str) -> DataFrame:
    lines = L.document_lines(spark, sf).withColumn("norm", text_fn.normalise(F.col("raw")))
    return lines.where("norm <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "norm")


@query
def file_extension(spark: SparkSession, sf: str) -> DataFrame:
    paths = L.lineitem_changes(spark, sf).select(F.col("file_path").alias("path")).distinct()
    return paths.union(L.table(spark, sf, "pages").select("url")).select("path", text_fn.extension(F.col("path")).alias("ext"))


@query
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    paths = L.lineitem_changes(spark, sf).select("file_path").distinct()
    return paths.select("file_path", F.concat_ws("|", text_fn.excluded_prefixes(F.col("file_path"), prefix_table(CONFIG))).alias("prefixes"))


@query
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf).groupBy("diff_id", "file_path").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("left_out"))


@query
def hunk_build(spark: SparkSession, sf: str) -> DataFrame:
    joined = {c: F.concat_ws("|", c) for c in ("added", "removed", "context", "change_order")}
    return _hunks(spark, sf).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), "file_path", *[v.alias(c) for c, v in joined.items()])


@query
def hunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = {"hunk.lines_changed": "lines_changed", "hunk.added_lines": "added_lines", "hunk.removed_lines": "removed_lines", "hunk.context_lines": "context_lines"}
    return _measured(spark, sf).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), *[M.metric(k).alias(v) for k, v in names.items()])


@query
def hunk_change_balance(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(spark, sf).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), M.metric("hunk.change_balance").alias("change_balance"))


@query
def hunk_interleaving(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(spark, sf).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), M.metric("hunk.interleaving").alias("interleaving"))


@query
def event_interleaving(spark: SparkSession, sf: str) -> DataFrame:
    return L.event_changes(spark, sf).select("user_id", "day", F.size("change_order").cast("long").alias("changes"), exact_round(M.interleaving(F.col("change_order")), 2).alias("interleaving"))


@query
def hunk_score(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).hunk_analysis.select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), exact_round(F.col("score"), 4).alias("score"))


@query
def file_score(spark: SparkSession, sf: str) -> DataFrame:
    found = _analysis(spark, sf).file_analysis
    return found.select("diff_id", "path", F.col("hunk_count").cast("long").alias("hunk_count"), M.metric("file.lines_changed").cast("long").alias("lines_changed"), exact_round(F.col("score"), 4).alias("score"))


@query
def pair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = V.pair_candidates(_hunks(spark, sf))
    return found.select("diff_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dir").cast("long").alias("dir"))


@query
def exact_line_match(spark: SparkSession, sf: str) -> DataFrame:
    found = V.exact_matches(V.pair_candidates(_hunks(spark, sf)))
    return found.select("diff_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dir").cast("long").alias("dir"), F.col("exact").cast("long").alias("exact"), F.col("longest").cast("long").alias("longest"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """``a, b``: the different texts of removed and added lines that are left to be compared when hunks are paired."""
    left = V.exact_matches(V.pair_candidates(_hunks(spark, sf))).select(F.explode("gone").alias("g"), "come")
    return left.select(F.col("g.text").alias("a"), F.explode("come").alias("c")).select("a", F.col("c.text").alias("b")).distinct()


@query
def line_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select("a", "b", _millionths(indel_ratio(F.col("a"), F.col("b"))).alias("ratio_ppm"))


@query
def line_similarity_builtin(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select("a", "b", _millionths(indel_ratio_sql(F.col("a"), F.col("b"))).alias("ratio_ppm"))


@query
def line_greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    found = V.line_matches(V.exact_matches(V.pair_candidates(_hunks(spark, sf))))
    return found.select("diff_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dir").cast("long").alias("dir"), F.col("matches").cast("long").alias("matches"), _millionths(F.col("total")).alias("total_ppm"))


@query
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    found = V.pair_similarity(_hunks(spark, sf)).where(F.col("similarity") >= V.PAIR_LEAST)
    return found.select("diff_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _millionths(F.col("similarity")).alias("similarity_ppm"))


@query
def moves(spark: SparkSession, sf: str) -> DataFrame:
    found = _analysis(spark, sf).moves
    return found.select("diff_id", *[F.col(c).cast("long").alias(c) for c in ("move_id", "i", "j")], _millionths(F.col("similarity")).alias("similarity_ppm"), "move_type", F.col("length").cast("long").alias("length"))


@query
def move_edit_complexity(spark: SparkSession, sf: str) -> DataFrame:
    found = _analysis(spark, sf).move_analysis
    return found.select("diff_id", F.col("move_id").cast("long").alias("move_id"), M.metric("move.edit_complexity").alias("edit_complexity"), F.col("score"))


@query
def hunk_type(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).hunks.select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), "hunk_type")


@query
def singleton_hunks(spark: SparkSession, sf: str) -> DataFrame:
    a = _analysis(spark, sf)
    return V.singletons(a.hunks, a.moves).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"))


@query
def move_members(spark: SparkSession, sf: str) -> DataFrame:
    return V.members(_analysis(spark, sf).moves).select("diff_id", F.col("hunk_idx").cast("long").alias("hunk_idx"), F.col("move_id").cast("long").alias("move_id"))


def _overall(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    return _analysis(spark, sf).overall.select("diff_id", *[M.metric(f"overall.{m}").alias(c) for c, m in columns.items()])


@query
def overall_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _overall(spark, sf, files_changed="files_changed", lines_changed="lines_changed", added_lines="added_lines")


@query
def problematic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _overall(spark, sf, hunks="problematic_hunk_count", moves="problematic_move_count", files="problematic_file_count")


@query
def scatter_factor(spark: SparkSession, sf: str) -> DataFrame:
    return _overall(spark, sf, scatter_factor="scatter_factor")


@query
def mean_interleaving(spark: SparkSession, sf: str) -> DataFrame:
    return _overall(spark, sf, mean_interleaving="mean_interleaving")


@query
def overall_score(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).overall.select("diff_id", exact_round(F.col("score"), 4).alias("score"))


@query
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return A.violations(_analysis(spark, sf)).select("diff_id", *[F.col(c).cast("long").alias(c) for c in ("section", "subject")], "text")


@query
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return A.gate(_analysis(spark, sf)).select("diff_id", exact_round(F.col("score"), 2).alias("score"), "passed", F.concat_ws("|", "violations").alias("violations"))


@query
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return A.recommendations(_analysis(spark, sf)).select("diff_id", *[F.col(c).cast("long").alias(c) for c in ("section", "subject", "ord")], "location", "metric", "value", "remediation")


@query
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = A.report(_analysis(spark, sf), detailed=True)
    return found.select("diff_id", "score", "passed", F.col("files_changed").cast("long").alias("files_changed"), F.col("hunks_changed").cast("long").alias("hunks_changed"), F.size("recommendations").cast("long").alias("advice"))


@query
def report_json_text(spark: SparkSession, sf: str) -> DataFrame:
    return report_json(A.report(_analysis(spark, sf), detailed=True), detailed=True)


@query
def parse_patches(spark: SparkSession, sf: str) -> DataFrame:
    patches = L.rendered_patches(L.lineitem_changes(spark, sf))
    _, _, lines, _ = split_parsed(parse_diffs(patches))
    return lines.select(F.col("diff_id").cast("long").alias("diff_id"), "file_path", F.col("hunk_idx").cast("long").alias("hunk_idx"), (F.col("seq") + 1).cast("long").alias("seq"), "kind", F.regexp_replace("raw", "\n$", "").alias("raw"))


@query
def custom_metric(spark: SparkSession, sf: str) -> DataFrame:
    registry = M.default_registry(CONFIG)
    registry.add(M.HunkMetric("hunk.longest_line", M.INTEGER, lambda _: F.coalesce(F.array_max(F.transform(F.concat("added", "removed"), lambda x: F.length(x))), F.lit(0)).cast("long")))
    registry.add(M.OverallMetric("overall.longest_line", M.INTEGER, lambda _: F.max(M.metric("hunk.longest_line"))))
    return _analysis(spark, sf, registry).overall.select("diff_id", M.metric("overall.longest_line").cast("long").alias("longest_line"))
