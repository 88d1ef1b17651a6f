"""Lines to hunks and files.

Input lines: ``diff_id, file_idx, file_path, old_path, is_new, is_deleted, hunk_idx, seq, kind, raw`` with kind added,
removed or context; ``hunk_idx`` counts over the whole diff. All later keys begin with ``diff_id``, so one shuffle by it
serves every grouping, join and window that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hunkwise.config import Config, prefix_table
from hunkwise.functions.text import excluded_prefixes, normalise, starts_with_any

HUNK_KEY = ["diff_id", "file_idx", "hunk_idx"]


def filter_lines(lines: DataFrame, config: Config) -> DataFrame:
    """``lines`` with ``norm`` and ``kept``: a change line counts unless it is blank or begins with an excluded prefix."""
    found = lines.withColumn("norm", F.when(F.col("kind") != "context", normalise(F.col("raw"))))
    excluded = starts_with_any(F.col("norm"), excluded_prefixes(F.col("file_path"), prefix_table(config)))
    return found.withColumn("kept", F.coalesce((F.col("kind") != "context") & (F.col("norm") != "") & ~excluded, F.lit(False)))


def build_hunks(filtered: DataFrame) -> DataFrame:
    """One row per hunk: its added, removed and context lines, the order of its changes, and counts.

    ``added_occ`` and ``removed_occ`` say the how-manieth of its text on its side each line is. They are counted by a
    sort within what is shuffled by diff anyway, so a hunk of very many lines costs no more than its share.
    """
    same = W.partitionBy(*HUNK_KEY, "kind", "kept", "norm").orderBy("seq")
    numbered = filtered.repartition("diff_id").withColumn("occ", F.row_number().over(same))
    line = F.struct("seq", "kind", "kept", "norm", "raw", "occ")
    grouped = numbered.groupBy(*HUNK_KEY).agg(F.first("file_path").alias("file_path"), F.array_sort(F.collect_list(line)).alias("lines"))
    kept = F.filter("lines", lambda x: x["kept"])

    def side(kind: str, part: str):  # noqa: ANN202
        return F.transform(F.filter("changes", lambda x: x["kind"] == kind), lambda x: x[part])

    return (
        grouped.withColumn("changes", kept)
        .withColumns({
            "added": side("added", "norm"),
            "removed": side("removed", "norm"),
            "added_occ": side("added", "occ"),
            "removed_occ": side("removed", "occ"),
            "context": F.transform(F.filter("lines", lambda x: x["kind"] == "context"), lambda x: x["raw"]),
            "change_order": F.transform("changes", lambda x: x["kind"]),
        })
        .drop("lines", "changes")
        .withColumns({"added_count": F.size("added"), "removed_count": F.size("removed"), "context_count": F.size("context")})
    )


def files_of(lines: DataFrame) -> DataFrame:
    """One row per file that has lines; a parser also knows files without any."""
    return lines.groupBy("diff_id", "file_idx").agg(F.first("file_path").alias("path"), F.first("old_path").alias("old_path"), F.first("is_new").alias("is_new"), F.first("is_deleted").alias("is_deleted"))
