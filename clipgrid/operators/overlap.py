"""Masks against boxes: overlap scores, the best tube and the best candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.boxes import clamp_box, clamp_box_for_iou
from clipgrid.operators.skew import join_by_key, not_broadcast
from clipgrid.operators.spans import box_overlap

_MASK = ["vid", "tube_id", "frame_idx"]
#: Key of a mask of a tube set.
SET_MASK = ["set_id", "tube_id", "frame_idx"]


def _sums_at_box(spans: DataFrame, frames: DataFrame, boxes: DataFrame, clamp) -> DataFrame:
    """One row per mask on a box's frame: ``area``, ``inter`` and ``box_pixels``.

    Masks find their box by clip and frame, then runs find their mask by its key, which bounds a group to one
    image. The sums follow the join in the same partitions, and masks without runs keep their row.
    """
    at = ["vid", "frame_idx"]
    return _sums_of_masks(spans, join_by_key(frames.select(*_MASK, "height", "width"), boxes.select(*at, "bbox"), at), clamp)


def _sums_of_masks(spans: DataFrame, masks: DataFrame, clamp, key: Sequence[str] = _MASK) -> DataFrame:
    """The same for masks that have found their ``bbox``, with the key of a mask."""
    clamped = clamp(F.col("bbox"), F.col("width"), F.col("height"))
    pixels = F.greatest(F.lit(0), clamped["xmax"] - clamped["xmin"]).cast("long") * F.greatest(
        F.lit(0), clamped["ymax"] - clamped["ymin"]
    )
    group = [*dict.fromkeys([*key, *_MASK]), "box_pixels"]
    sized = masks.withColumn("box_pixels", pixels).select(*group, clamped.alias("bbox"))
    length, shared = box_overlap(spans, F.col("bbox"))
    return (
        sized.join(not_broadcast(spans), list(key), "left")
        .groupBy(*group)
        .agg(F.coalesce(F.sum(length), F.lit(0)).alias("area"), F.coalesce(F.sum(shared), F.lit(0)).alias("inter"))
    )


def mask_box_iou(spans: DataFrame, frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Intersection over union of every mask on a box's frame with that box; 0 for a degenerate box.

    ``spans`` are canonical masks; ``boxes`` has one ``bbox`` per ``vid, frame_idx``.
    """
    sums = _sums_at_box(spans, frames, boxes, clamp_box_for_iou)
    union = F.col("area") + F.col("box_pixels") - F.col("inter")
    iou = F.when((F.col("box_pixels") > 0) & (union > 0), F.col("inter") / union).otherwise(F.lit(0.0))
    return sums.withColumn("iou", iou)


def tube_scores(spans: DataFrame, frames: DataFrame, boxes: DataFrame, mode: str) -> DataFrame:
    """Overlap of each tube with the box on the key frame; tubes without a mask there are not scored.

    ``relative`` divides by the mask, ``absolute`` by the box. There is no default: the two answer different
    questions.
    """
    return _with_ratio(_sums_at_box(spans, frames, boxes, clamp_box), mode)


def set_scores(spans: DataFrame, masks: DataFrame, mode: str) -> DataFrame:
    """The same for tubes of sets that clips share: ``masks`` has ``vid, bbox`` beside the key and size of each mask.

    Runs find their mask by ``set_id, tube_id, frame_idx`` and are not shuffled again where they are distributed by it.
    """
    return _with_ratio(_sums_of_masks(spans, masks, clamp_box, SET_MASK), mode)


def _with_ratio(sums: DataFrame, mode: str) -> DataFrame:
    if mode not in ("relative", "absolute"):
        raise ValueError(f"mode must be 'relative' or 'absolute', got {mode!r}")
    base = F.col("area") if mode == "relative" else F.col("box_pixels")
    return sums.withColumn("ratio", F.when(base > 0, F.col("inter") / base).otherwise(F.lit(0.0)))


def pick_tubes(scores: DataFrame, threshold: float, position: str = "tube_id") -> DataFrame:
    """Best tube per clip, the first one on ties, if it reaches the threshold."""
    best = F.struct("tube_id", "ratio")
    rank = F.struct(F.col("ratio"), (-F.col(position)).alias("earliest"))
    return (
        scores.groupBy("vid")
        .agg(F.max_by(best, rank).alias("_best"))
        .select("vid", F.col("_best.tube_id").alias("tube_id"), F.col("_best.ratio").alias("score"))
        .filter(F.col("score") >= threshold)
    )


def pick_candidates(scores: DataFrame, keys: Sequence[str] = ("vid",), candidate: str = "tube_id") -> DataFrame:
    """Best candidate mask per clip by IoU, the first one on ties, with the number of candidates.

    The scores of all candidates are the rows of ``scores`` itself.
    """
    best = F.struct(F.col(candidate), F.col("iou"))
    rank = F.struct(F.col("iou"), (-F.col(candidate)).alias("earliest"))
    return (
        scores.groupBy(*keys)
        .agg(F.max_by(best, rank).alias("_best"), F.count(F.lit(1)).alias("num_candidates"))
        .select(
            *keys,
            F.col(f"_best.{candidate}").alias(candidate),
            F.col("_best.iou").alias("iou"),
            "num_candidates",
        )
    )
