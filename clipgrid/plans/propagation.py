"""From boxes to mask tubes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.boxes import clamp_box
from clipgrid.functions.choices import prompt_by_type, read_frame
from clipgrid.functions.names import base_vid
from clipgrid.operators.chunks import propagate_in_chunks
from clipgrid.operators.joins import with_grounding
from clipgrid.operators.outcomes import (
    BOX_PROPAGATION,
    NO_OUTPUT,
    TUBE_SELECTION,
    VIDEO_NOT_FOUND,
    outcome_rows,
    propagation_method,
)
from clipgrid.operators.overlap import SET_MASK, pick_tubes, set_scores
from clipgrid.operators.scoring import Registry, chunk_propagator
from clipgrid.operators.skew import join_by_key
from clipgrid.operators.spans import box_runs
from clipgrid.operators.tubes import hold_boxes
from clipgrid.session import cut_lineage
from clipgrid.sources.tubes import attach_tube_sets

# Frames per chunk, and those that neighbouring chunks share.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 16


@dataclass(frozen=True)
class Propagation:
    """Masks of all clips, and one outcome per clip."""

    outcomes: DataFrame
    frames: DataFrame
    spans: DataFrame


def propagate(
    key_frames: DataFrame,
    grounding: DataFrame,
    media: DataFrame,
    tube_sets: DataFrame,
    tube_frames: DataFrame,
    tube_spans: DataFrame,
    mode: str,
    threshold: float,
    sentence_type: str = "declarative",
    settle: Callable[[DataFrame], DataFrame] = cut_lineage,
    propagators: Registry | None = None,
    backend: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
) -> Propagation:
    """Pick a ready tube where one fits the box, else hold the box over the clip; clips without a box fail.

    Every key frame has an outcome: a clip whose path is null or not listed in ``media`` fails as ``video_not_found``.

    The state of a clip, its pick, its box to be held and the masks of a picked tube are one small row each that several results
    start from, so ``settle`` writes them out once.

    With ``propagators`` the one named ``backend`` takes the place of holding the box. Every clip then goes through
    chunks of ``chunk_size`` frames, a short one as a single chunk.

    ``media`` has ``video_path, num_frames, height, width``; tubes are keyed by ``set_id, tube_id, frame_idx``.
    """
    joined = with_grounding(key_frames, grounding).withColumns(
        {
            "base_vid": base_vid(F.col("vid")),
            "key_frame_idx": read_frame(F.col("original_frame_idx"), F.col("key_frame_idx")),
            "prompt": prompt_by_type(
                F.lit(sentence_type), F.col("target_object"), F.col("answer"), F.col("text_query")
            ),
        }
    )
    listed = media.select("video_path", "num_frames", "height", "width", F.lit(True).alias("_listed"))
    sized = joined.drop("num_frames", "height", "width").join(listed, "video_path", "left").withColumn("has_media", F.coalesce("_listed", F.lit(False))).drop("_listed")
    clips = settle(
        attach_tube_sets(sized, tube_sets, tube_frames).withColumns(
            {
                "box_ok": F.col("success"),
                "tubes_ok": F.col("tube_state") == "tubes",
                "bbox": clamp_box(F.col("bbox"), F.col("width"), F.col("height")),
            }
        )
    )
    at = clips.filter("has_media AND box_ok AND tubes_ok AND bbox IS NOT NULL").select(
        "set_id", "vid", F.col("key_frame_idx").alias("frame_idx"), "bbox"
    )
    # A frame of a set bounds the masks that meet there. Runs find them by the key of the mask, so united runs do not move again.
    on_key = join_by_key(tube_frames.select(*SET_MASK, "height", "width"), at, ["set_id", "frame_idx"])
    runs = tube_spans.select(*SET_MASK, "y", "x0", "x1")
    scores = set_scores(runs, on_key, mode)
    picks = settle(pick_tubes(scores, threshold).select("vid", F.col("tube_id").alias("selected_tube_id"), "score"))
    method = propagation_method(
        F.col("box_ok"), F.col("bbox").isNotNull(), F.col("tubes_ok"), F.col("selected_tube_id")
    )
    method = F.when(F.col("has_media"), method).otherwise(F.lit(NO_OUTPUT))
    decided = clips.join(picks, "vid", "left").withColumn("method", method)
    # What a method implies of the clip alone is asked for again, so that other clips are not shuffled to the picks.
    with_box = decided.filter("has_media AND box_ok AND bbox IS NOT NULL")
    chosen = with_box.filter(F.col("tubes_ok") & (F.col("method") == TUBE_SELECTION) & F.col("selected_tube_id").isNotNull()).select(
        "vid", "set_id", F.col("selected_tube_id").alias("tube_id")
    )
    # The masks of the picked tubes, one row each; their runs come by the key of the mask too, so a long tube is no large group.
    picked = settle(join_by_key(tube_frames.select(*SET_MASK, "height", "width"), chosen, ["set_id", "tube_id"]))
    picked_frames = picked.select("vid", "frame_idx", "height", "width")
    picked_spans = join_by_key(runs, picked.select("vid", *SET_MASK), SET_MASK).select("vid", "frame_idx", "y", "x0", "x1")
    boxed = settle(with_box.filter(F.col("method") == BOX_PROPAGATION))
    if propagators is None:
        held_frames, held_spans = hold_boxes(boxed)
    else:
        prompt = boxed.select("vid", F.col("key_frame_idx").alias("frame_idx"), "height", "width")
        box = box_runs(boxed.withColumn("frame_idx", F.col("key_frame_idx")), ["vid", "frame_idx"])
        apply = chunk_propagator(propagators, backend, boxed.select("vid", "video_path", F.col("prompt").alias("prompt_text")))
        held_frames, held_spans = propagate_in_chunks(boxed, prompt, box, apply, chunk_size, chunk_overlap)
    frames = picked_frames.unionByName(held_frames)
    spans = picked_spans.unionByName(held_spans)
    outcomes = outcome_rows(decided.drop("set_id"), frames)
    reason = F.when(F.col("has_media"), F.col("failure_reason")).otherwise(F.lit(VIDEO_NOT_FOUND))
    return Propagation(outcomes.withColumn("failure_reason", reason).drop("has_media"), frames, spans)
