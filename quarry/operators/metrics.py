"""Stage timings (M12: ``conv_id, turn, stage, seconds``) → totals, averages, last run.

A run is one ``(conv_id, turn)``.  As in the reference, a run that found
nothing still adds its search time but is not counted as a run; pass an
``answered`` boolean column to mark those (default: every run counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _answered(timings: DataFrame):
    return F.col("answered") if "answered" in timings.columns else F.lit(True)


def stage_totals(timings: DataFrame) -> DataFrame:
    """``stage, seconds, runs``: total seconds per stage and the number of counted runs."""
    per_stage = timings.groupBy("stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"))
    runs = timings.filter(_answered(timings)).select("conv_id", "turn").distinct().select(F.count(F.lit(1))).scalar()
    return per_stage.withColumn("runs", runs)


def stage_averages(timings: DataFrame) -> DataFrame:
    """``stage, avg_seconds``; nothing when no run was counted."""
    t = stage_totals(timings)
    return t.filter(F.col("runs") > 0).select("stage", F.round(F.col("seconds") / F.col("runs"), 6).alias("avg_seconds"))


def last_run_stats(timings: DataFrame) -> DataFrame:
    """Seconds of each stage in the latest run of each conversation."""
    return timings.groupBy("conv_id", "stage").agg(
        F.max_by("seconds", "turn").alias("seconds"), F.max("turn").alias("turn"))
