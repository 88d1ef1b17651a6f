"""Reports for patch files as they arrive: each micro-batch is analysed on its own, since no state crosses diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hunkwise.config import Config
from hunkwise.plans.analysis import analyse, report
from hunkwise.plans.render import report_json
from hunkwise.sources.patches import parse_diffs, split_parsed


def stream_reports(spark: SparkSession, folder: str, out: str, state: str, config: Config, detailed: bool = False) -> StreamingQuery:
    """Watches ``folder`` for patch files and writes ``diff_id, json`` under ``out``, a folder for each batch."""
    arriving = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("diff_id"), F.col("value").alias("diff_text"))

    def analysed(batch: DataFrame, number: int) -> None:
        parsed = parse_diffs(batch).persist()
        diffs, files, lines, errors = split_parsed(parsed)
        analysis = analyse(lines, files, config, diffs)
        made = report_json(report(analysis, detailed), detailed)
        failed = errors.select("diff_id", F.to_json(F.struct("parse_error")).alias("json"))
        made.unionByName(failed).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself
        analysis.release()
        parsed.unpersist()

    return arriving.writeStream.foreachBatch(analysed).option("checkpointLocation", state).trigger(availableNow=True).start()
