"""Which way a clip takes, and how its run ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the ways a clip can take; jobs may pass their own.
TUBE_SELECTION = "tube_selection"
BOX_PROPAGATION = "box_propagation"
NO_OUTPUT = "no_output"
# Reason of a clip whose media file is not known.
VIDEO_NOT_FOUND = "video_not_found"


def propagation_method(
    box_ok: Column,
    has_box: Column,
    tubes_ok: Column,
    selected_tube: Column,
    tube_selection: str = TUBE_SELECTION,
    box_propagation: str = BOX_PROPAGATION,
) -> Column:
    """Tubes and box: pick a tube, else propagate the box. Box only: propagate. No box: nothing."""
    return (
        F.when(
            box_ok & tubes_ok,
            F.when(selected_tube.isNull() & has_box, F.lit(box_propagation)).otherwise(F.lit(tube_selection)),
        )
        .when(box_ok, F.lit(box_propagation))
        .otherwise(F.lit(NO_OUTPUT))
    )


def mask_count_reason(num_masks: Column) -> Column:
    """No mask, or only the prompt itself, is a failure."""
    return F.when(num_masks == 0, F.lit("no_masks_generated")).when(
        num_masks == 1, F.lit("insufficient_masks_propagation_failed")
    )


def refine_reason(reason: Column, method: Column, box_ok: Column, tubes_ok: Column) -> Column:
    """An empty result of a propagation is put down to memory or the propagator."""
    propagating = F.coalesce(F.lower(method).rlike("tracker|propagation"), F.lit(False))
    blamed = (reason == "no_masks_generated") & (propagating | (box_ok & ~tubes_ok))
    return F.when(blamed, F.lit("oom_or_propagation_failed")).otherwise(reason)


def outcome_rows(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """One outcome per clip from its masks.

    ``clips`` has ``vid, method, box_ok, tubes_ok`` and whatever else should be kept; ``frames`` one row per mask.
    A failed clip reports no masks.
    """
    counts = frames.groupBy("vid").agg(F.count(F.lit(1)).alias("_masks"))
    joined = clips.join(counts, "vid", "left").withColumn("_masks", F.coalesce("_masks", F.lit(0)))
    reason = refine_reason(mask_count_reason(F.col("_masks")), F.col("method"), F.col("box_ok"), F.col("tubes_ok"))
    return (
        joined.withColumn("failure_reason", reason)
        .withColumn("status", F.when(F.col("failure_reason").isNull(), F.lit("success")).otherwise(F.lit("failed")))
        .withColumn("num_masks", F.when(F.col("status") == "success", F.col("_masks")).otherwise(F.lit(0)))
        .drop("_masks")
    )
