"""From sentences and frame vectors to key frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.scores import clean_score
from clipgrid.functions.text import is_question, target_object
from clipgrid.operators.resume import drop_finished_key_frames
from clipgrid.operators.sampling import TARGET_FPS, pick_key_frames, sample_frames
from clipgrid.operators.scoring import similarity_scores
from clipgrid.operators.skew import not_broadcast


def score_frames(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """Clean match score of every sampled frame."""
    scored = similarity_scores(frames, queries)
    return scored.withColumn("score", clean_score(F.col("score")))


def find_key_frames(
    clips: DataFrame,
    frames: DataFrame,
    queries: DataFrame,
    finished: DataFrame | None = None,
    fps: float = TARGET_FPS,
) -> DataFrame:
    """Key-frame record of every clip that is not finished.

    ``clips`` has ``vid, text_query, num_frames, video_fps``; ``frames`` one ``vector`` per ``vid, frame_idx``;
    ``queries`` the ``query_vector`` per ``vid``; ``finished`` the file listing of earlier runs.
    """
    pending = clips if finished is None else drop_finished_key_frames(clips, finished, ["vid"])
    sampled = sample_frames(pending, fps_target=fps).select("vid", "sample_idx", "frame_idx")
    # The sampled frames are unfolded, so their size is not known to the planner.
    chosen = frames.select("vid", "frame_idx", "vector").join(not_broadcast(sampled), ["vid", "frame_idx"])
    scores = score_frames(chosen, queries)
    picks = pick_key_frames(scores).withColumnRenamed("frame_idx", "original_frame_idx")
    question = is_question(F.col("text_query"))
    reply = F.col("reply") if "reply" in clips.columns else F.lit(None).cast("string")
    return pending.join(picks, "vid").withColumns(
        {"target_object": target_object(reply, F.col("text_query"), question), "sampling_fps": F.lit(float(fps))}
    )
