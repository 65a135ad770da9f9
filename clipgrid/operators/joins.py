"""Joins between the tables of the processing steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.choices import prompt, read_frame
from clipgrid.operators.sampling import SOURCE_FPS
from clipgrid.operators.validate import usable_grounding


def propagation_inputs(key_frames: DataFrame, grounding: DataFrame) -> DataFrame:
    """Key frames with their grounding: both must exist. Text fields come from the grounding."""
    left = key_frames.select(
        "vid",
        "video_path",
        "key_frame_path",
        read_frame(F.col("original_frame_idx"), F.col("key_frame_idx")).alias("key_frame_idx"),
    )
    right = grounding.select(
        "vid",
        "text_query",
        "target_object",
        "answer",
        "bbox",
        F.col("success").alias("grounding_success"),
        F.col("method").alias("grounding_method"),
    )
    joined = left.join(right, "vid")
    return joined.withColumn("prompt", prompt(F.col("answer"), F.col("target_object"), F.col("text_query")))


def with_grounding(key_frames: DataFrame, grounding: DataFrame) -> DataFrame:
    """All key frames with their grounding if any; a missing one counts as not successful."""
    right = grounding.select("vid", "success", "bbox", "answer")
    return key_frames.join(right, "vid", "left").withColumn("success", F.coalesce("success", F.lit(False)))


def alternate_boxes(rows: DataFrame, grounding: DataFrame, name: str = "alternate_bbox") -> DataFrame:
    """Attach the box of another grounding run, where that run succeeded."""
    usable = grounding.filter(usable_grounding()).select("vid", F.col("bbox").alias(name))
    return rows.join(usable, "vid", "left")


def with_key_frame_path(results: DataFrame, records: DataFrame) -> DataFrame:
    """Attach the key-frame path of the record; null where there is no record."""
    return results.join(records.select("vid", "key_frame_path"), "vid", "left")


def lookup_fps(
    clips: DataFrame,
    annotations: DataFrame,
    position: str,
    default: float = SOURCE_FPS,
    last_wins: bool = True,
    key: str = "vid",
) -> DataFrame:
    """Attach the frame rate stated by the annotations; of several for one video the last (or first) one counts."""
    stated = F.struct(F.coalesce(F.col("fps"), F.lit(default)).alias("fps"))
    pick = F.max_by(stated, F.col(position)) if last_wins else F.min_by(stated, F.col(position))
    rates = annotations.groupBy(key).agg(pick.alias("_rate")).select(key, F.col("_rate.fps").alias("video_fps"))
    return clips.join(rates, key, "left").withColumn("video_fps", F.coalesce("video_fps", F.lit(default)))


def survivors(rows: DataFrame, steps: Sequence[DataFrame], key: str = "vid") -> DataFrame:
    """Rows that every step produced a result for; each step contributes its own columns."""
    for step in steps:
        rows = rows.join(step, key)
    return rows


def attach_existing(rows: DataFrame, files: DataFrame, path: Column, name: str) -> DataFrame:
    """Add a file path where the listing has that file, else null. ``files`` has a distinct ``path``."""
    listed = files.select(F.col("path").alias("_wanted"), F.col("path").alias(name))
    return rows.withColumn("_wanted", path).join(listed, "_wanted", "left").drop("_wanted")


def filter_existing(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose file is listed."""
    return rows.join(files.select(F.col("path").alias(path)), path, "left_semi")
