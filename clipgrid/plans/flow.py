"""One call from sentences and frame vectors to mask tubes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.operators.joins import attach_existing
from clipgrid.operators.scoring import Registry
from clipgrid.plans.grounding import ground
from clipgrid.plans.keyframes import find_key_frames
from clipgrid.plans.propagation import CHUNK_OVERLAP, CHUNK_SIZE, Propagation, propagate
from clipgrid.session import cut_lineage


@dataclass(frozen=True)
class Flow:
    """What every step gives; each step's table is written once, as the next ones start from it."""

    key_frames: DataFrame
    grounding: DataFrame
    propagation: Propagation


def run_flow(
    clips: DataFrame,
    frames: DataFrame,
    queries: DataFrame,
    scorers: Registry,
    method: str,
    media: DataFrame,
    tube_sets: DataFrame,
    tube_frames: DataFrame,
    tube_spans: DataFrame,
    mode: str,
    threshold: float,
    propagators: Registry | None = None,
    backend: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    fps: float | None = None,
    images: DataFrame | None = None,
) -> Flow:
    """Key frame, box and tube of every clip.

    ``clips`` has ``vid, text_query, num_frames, video_fps, video_path``; the other inputs are those of the steps.
    ``images`` (``path``) lists key-frame images named ``vid/frame``, to hand their path to the scorer.
    """
    rate = {} if fps is None else {"fps": fps}
    picked = find_key_frames(clips, frames, queries, **rate)
    if images is not None:
        place = F.concat_ws("/", "vid", F.col("original_frame_idx").cast("string"))
        picked = attach_existing(picked, images, place, "key_frame_path")
    key_frames = cut_lineage(picked)
    grounding = cut_lineage(ground(key_frames, scorers, method))
    found = propagate(
        key_frames,
        grounding,
        media,
        tube_sets,
        tube_frames,
        tube_spans,
        mode,
        threshold,
        propagators=propagators,
        backend=backend,
        chunk_size=chunk_size,
        chunk_overlap=chunk_overlap,
    )
    return Flow(key_frames, grounding, found)
