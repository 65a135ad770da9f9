"""Counts and rates over outcomes, captions and tubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _outcome_aggs(success: Column) -> list[Column]:
    ok = F.count_if(success)
    total = F.count(F.lit(1))
    return [
        total.alias("total"),
        ok.alias("succeeded"),
        (total - ok).alias("failed"),
        (F.try_divide(ok, total) * 100).alias("success_rate"),
    ]


def outcome_counts(outcomes: DataFrame, success: Column, by: Sequence[str] = ()) -> DataFrame:
    """Total, succeeded, failed and success rate in percent, overall or per group (for instance per worker)."""
    flag = F.coalesce(success, F.lit(False))
    return outcomes.groupBy(*by).agg(*_outcome_aggs(flag))


def outcome_rollup(outcomes: DataFrame, success: Column, by: Sequence[str]) -> DataFrame:
    """The same with subtotals over the leading columns and a grand total (null group columns)."""
    flag = F.coalesce(success, F.lit(False))
    return outcomes.rollup(*by).agg(*_outcome_aggs(flag), F.grouping_id().alias("level"))


def run_summary(all_clips: DataFrame, pending: DataFrame, results: DataFrame, success: Column) -> DataFrame:
    """One row: clips given, skipped as finished, succeeded, failed and the rate among those processed.

    Clips that were tried but left no result count as failed.
    """
    parts = (
        all_clips.select(F.lit("given").alias("_part"), F.lit(False).alias("_good"))
        .unionByName(pending.select(F.lit("tried").alias("_part"), F.lit(False).alias("_good")))
        .unionByName(results.select(F.lit("done").alias("_part"), F.coalesce(success, F.lit(False)).alias("_good")))
    )
    counts = parts.agg(
        F.count_if(F.col("_part") == "given").alias("total"),
        F.count_if(F.col("_part") == "tried").alias("processed"),
        F.count_if("_good").alias("succeeded"),
    )
    return counts.select(
        "total",
        (F.col("total") - F.col("processed")).alias("skipped"),
        "processed",
        "succeeded",
        (F.col("processed") - F.col("succeeded")).alias("failed"),
        (F.try_divide(F.col("succeeded"), F.col("processed")) * 100).alias("success_rate"),
    )


def score_stats(scores: DataFrame, keys: Sequence[str] = ("vid",), score: str = "score") -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )


def caption_types(captions: DataFrame, column: str = "caption_type") -> DataFrame:
    """Distinct caption types with their counts; a missing type is listed as ``None``."""
    named = F.coalesce(F.col(column), F.lit("None")).alias(column)
    return captions.groupBy(named).agg(F.count(F.lit(1)).alias("num_captions"))


def tubes_per_set(frames: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Tubes and masks per set. Two-step: distinct tubes are found on the map side."""
    per_tube = frames.groupBy(*keys, "tube_id").agg(F.count(F.lit(1)).alias("_masks"))
    return per_tube.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_tubes"), F.sum("_masks").alias("num_masks"))


def frames_per_tube(frames: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Frames of every tube: count, first and last."""
    return frames.groupBy(*keys, "tube_id").agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
    )
