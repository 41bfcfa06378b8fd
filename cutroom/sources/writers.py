"""Sinks: nested reports, subtitles, caption files and per-task reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutroom.functions.text import format_time


def write_strategy_report(report: DataFrame, path: str) -> None:
    """SNK-1. One JSON object per channel."""
    report.write.mode("overwrite").json(path)


def srt_texts(cues: DataFrame, by: str, order: str = "cue_idx") -> DataFrame:
    """SNK-2. (by, srt): cues numbered anew from 1, each with a blank line behind it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    block = F.concat(n.cast("string"), F.lit("\n"), format_time(F.col("start")), F.lit(" --> "), format_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = cues.withColumns({"__b": block})
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__b"))), lambda x: x["__b"]), "").alias("srt"))


def write_srt(cues: DataFrame, by: str, path: str) -> None:
    srt_texts(cues, by).write.mode("overwrite").partitionBy(by).text(path)


def write_caption_json(captions: DataFrame, path: str) -> None:
    """SNK-3. One JSON object per caption."""
    captions.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_quality_reports(reports: DataFrame, by: str, path: str) -> None:
    """SNK-4. Replace the reports of the tasks in ``reports``, and no others, whole."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
