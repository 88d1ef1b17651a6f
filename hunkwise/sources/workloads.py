"""Tables seen as change logs.

``lineitem_changes``: a customer's orders are one diff, an order is a hunk, an order priority a file, a line item a line
whose text is its part's name. ``document_lines``: a document's lines. ``event_changes``: a user's day of events in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.config import Config

#: Limits near the means of ``lineitem_changes``, so that both gate outcomes occur.
LINEITEM_CONFIG = Config(
    hunk_score_threshold=0.5, file_score_threshold=0.5, max_diff_lines=8, max_hunk_lines=3, max_move_lines=6, move_similarity_penalty=2.0,
    min_overall_score=0.4, max_problematic_hunks=1, max_problematic_moves=2, max_problematic_files=0, max_files_changed=4, max_added_lines=4,
    excluded_prefixes={".py": ["hot ", "red "], ".js": ["cold "], ".md": [], "*": ["small "]},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priority_path(priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    suffix = F.when(first == "1", ".py").when(first == "2", ".JS").when(first == "3", ".md").when(first == "4", ".tar.py").otherwise("")
    return F.concat(F.lit("src/p"), first, suffix)


def lineitem_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the canonical model. One window shuffle by order, one by customer."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("diff_id"), priority_path(F.col("o_orderpriority")).alias("file_path"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("raw"))
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("context")
    by_order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    by_diff = W.partitionBy("diff_id")
    rows = items.join(orders, "l_orderkey").join(parts, "l_partkey").withColumn("seq", F.row_number().over(by_order))
    return rows.select(
        "diff_id",
        (F.dense_rank().over(by_diff.orderBy("file_path")) - 1).alias("file_idx"),
        "file_path",
        F.lit(None).cast("string").alias("old_path"),
        F.lit(False).alias("is_new"),
        F.lit(False).alias("is_deleted"),
        (F.dense_rank().over(by_diff.orderBy("file_path", "l_orderkey")) - 1).alias("hunk_idx"),
        "seq",
        kind.alias("kind"),
        "raw",
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, pos, raw, file_path``: the language stands for the extension."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.concat(F.lit("doc/x."), "lang").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, day, change_order``: clicks and views add, errors and purchases remove, sign-ups are context."""
    events = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    kind = F.when(F.col("event_type").isin("click", "view"), "added").otherwise("removed")
    grouped = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", kind.alias("kind")))).alias("e"))
    return grouped.select("user_id", "day", F.transform("e", lambda x: x["kind"]).alias("change_order"))


def rendered_patches(lines: DataFrame) -> DataFrame:
    """``diff_id, diff_text``: the changes as unified diff text."""
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise(" ")
    body = F.concat(sign, F.col("raw"))
    hunks = lines.groupBy("diff_id", "file_idx", "file_path", "hunk_idx").agg(
        F.count_if(F.col("kind") != "added").alias("old"), F.count_if(F.col("kind") != "removed").alias("new"), F.array_sort(F.collect_list(F.struct("seq", body.alias("b")))).alias("body")
    )
    head = F.format_string("@@ -%d,%d +%d,%d @@\n", F.lit(1) + F.col("hunk_idx") * 100, "old", F.lit(1) + F.col("hunk_idx") * 100, "new")
    hunks = hunks.withColumn("text", F.concat(head, F.array_join(F.transform("body", lambda x: x["b"]), "\n")))
    files = hunks.groupBy("diff_id", "file_idx", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    files = files.withColumn("text", F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\n--- a/"), "file_path", F.lit("\n+++ b/"), "file_path", F.lit("\n"), "text", F.lit("\n")))
    whole = files.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "text"))), lambda x: x["text"]), "").alias("diff_text"))
    return whole.select(F.col("diff_id").cast("string").alias("diff_id"), "diff_text")
