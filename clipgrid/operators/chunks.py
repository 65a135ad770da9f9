"""Overlapping frame chunks: cutting, assignment, merge and hand-over."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.operators.skew import join_by_group, not_broadcast, unfold
from clipgrid.operators.spans import covered_runs
from clipgrid.session import cut_lineage, remove_folder, shared_folder


def check_chunking(size: int, overlap: int) -> int:
    """The step from one chunk to the next; an overlap of a whole chunk would never advance."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")
    return size - overlap


def chunk_count(num_frames: Column, size: int, overlap: int) -> Column:
    step = check_chunking(size, overlap)
    extra = F.ceil(F.greatest(num_frames - size, F.lit(0)) / step)
    return F.when(num_frames > 0, 1 + extra).otherwise(F.lit(0)).cast("long")


def chunk_start(chunk_id: Column, size: int, overlap: int) -> Column:
    return chunk_id * check_chunking(size, overlap)


def chunk_end(chunk_id: Column, num_frames: Column, size: int, overlap: int) -> Column:
    return F.least(chunk_start(chunk_id, size, overlap) + size, num_frames)


def first_chunk_of(frame_idx: Column, size: int, overlap: int) -> Column:
    """First chunk that reaches past the frame."""
    step = check_chunking(size, overlap)
    return F.greatest(F.lit(0), F.floor((frame_idx - size) / step) + 1).cast("long")


def main_chunk(key_frame_idx: Column, num_frames: Column, size: int, overlap: int) -> Column:
    """First chunk that holds the key frame; null if the clip does not contain it."""
    inside = (key_frame_idx >= 0) & (key_frame_idx < num_frames)
    return F.when(inside, first_chunk_of(key_frame_idx, size, overlap))


def cut_chunks(
    clips: DataFrame,
    size: int,
    overlap: int,
    num_frames: str = "num_frames",
    keys: Sequence[str] = ("vid",),
) -> DataFrame:
    """One row per chunk with its half-open frame range."""
    count = chunk_count(F.col(num_frames), size, overlap)
    rows = unfold(clips, count, "chunk_id", keys)
    return rows.withColumn("chunk_start", chunk_start(F.col("chunk_id"), size, overlap)).withColumn(
        "chunk_end", chunk_end(F.col("chunk_id"), F.col(num_frames), size, overlap)
    )


def assign_chunks(
    frames: DataFrame, size: int, overlap: int, frame_idx: str = "frame_idx", num_frames: str = "num_frames"
) -> DataFrame:
    """Each frame once per chunk that holds it, with its index inside the chunk.

    Chunk numbers follow from the frame index, so no join with the chunk table is needed.
    """
    step = check_chunking(size, overlap)
    frame = F.col(frame_idx)
    inside = (frame >= 0) & (frame < F.col(num_frames))
    first = first_chunk_of(frame, size, overlap)
    last = F.least(F.floor(frame / step), chunk_count(F.col(num_frames), size, overlap) - 1)
    return (
        frames.filter(inside)
        .withColumn("chunk_id", F.explode(F.sequence(first, last)))
        .withColumn("local_idx", frame - chunk_start(F.col("chunk_id"), size, overlap))
    )


def merge_source(frame_idx: Column, boundary: Column, backward: Column, overlap: int) -> Column:
    """Which mask a frame keeps when both chunks have one: ``new``, ``old`` or ``both`` (their intersection).

    ``boundary`` is the start of the later chunk when going backward and the end of the earlier one when going
    forward. The new mask weighs in linearly over the configured overlap and a pixel stays above one half, which
    for binary masks is a choice per frame.
    """
    depth = F.when(backward, frame_idx - boundary).otherwise(boundary - frame_idx)
    outside = F.when(backward, frame_idx < boundary).otherwise(frame_idx >= boundary)
    return (
        F.when(outside, F.lit("new"))
        .when(depth * 2 > overlap, F.lit("new"))
        .when(depth * 2 < overlap, F.lit("old"))
        .otherwise(F.lit("both"))
    )


def merge_chunk_masks(
    old_frames: DataFrame,
    old_spans: DataFrame,
    new_frames: DataFrame,
    new_spans: DataFrame,
    overlap: int,
    keys: Sequence[str] = ("vid", "frame_idx"),
    carry: Sequence[str] = (),
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Merge the masks of a newly propagated chunk into the masks of the clip.

    ``new_frames`` carries ``boundary`` and ``backward``. Returns frames and spans; a frame only one side has
    keeps that side. ``carry`` names further columns both frame tables have. The choice per frame serves both
    results, so ``settle`` may write it out first.
    """
    key, extra = list(keys), ["height", "width", *carry]
    old = old_frames.select(*key, *[F.col(c).alias(f"_old_{c}") for c in extra], F.lit(True).alias("_old"))
    new = new_frames.select(*key, *extra, "boundary", "backward", F.lit(True).alias("_new"))
    source = (
        F.when(F.col("_new").isNull(), F.lit("old"))
        .when(F.col("_old").isNull(), F.lit("new"))
        .otherwise(merge_source(F.col("frame_idx"), F.col("boundary"), F.col("backward"), overlap))
    )
    chosen = settle(
        old.join(new, key, "full").select(
            *key, *[F.coalesce(f"_old_{c}", c).alias(c) for c in extra], source.alias("source")
        )
    )
    runs = ["y", "x0", "x1"]
    sides = old_spans.select(*key, *runs, F.lit("old").alias("_side")).unionByName(
        new_spans.select(*key, *runs, F.lit("new").alias("_side"))
    )
    kept = sides.join(not_broadcast(chosen.select(*key, *carry, "source")), key).filter(
        (F.col("source") == F.col("_side")) | (F.col("source") == "both")
    )
    need = F.when(F.col("source") == "both", F.lit(2)).otherwise(F.lit(1))
    merged = covered_runs(kept, [*key, *carry, "y", "source"], need, together=key)
    return chosen.select(*key, *extra), merged.select(*key, *carry, *runs)


Run = tuple[int, int, int]
Masks = dict[int, list[Run]]


def _sweep(runs: list[Run], need: int) -> list[Run]:
    """Maximal runs that at least ``need`` of the given runs of one mask cover, as ``covered_runs`` gives them."""
    ends: dict[tuple[int, int], int] = {}
    for y, x0, x1 in runs:
        if x1 > x0:
            ends[y, x0] = ends.get((y, x0), 0) + 1
            ends[y, x1] = ends.get((y, x1), 0) - 1
    found, depth = [], 0
    for (y, x), step in sorted(ends.items()):
        if depth < need <= depth + step:
            start = x
        elif depth + step < need <= depth:
            found.append((y, start, x))
        depth += step
    return found


def _chosen(old: list[Run], new: list[Run], frame: int, boundary: int, backward: bool, overlap: int) -> list[Run]:
    """What :func:`merge_source` says of a frame that both chunks have."""
    depth = frame - boundary if backward else boundary - frame
    outside = frame < boundary if backward else frame >= boundary
    if outside or 2 * depth > overlap:
        return new
    return old if 2 * depth < overlap else _sweep(old + new, 2)


def walk_chunks(apply: Callable[[pd.DataFrame], Any], row: pd.DataFrame, size: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Runs of all frames of one clip, chunk by chunk outward from the main chunk, as the waves give them.

    ``row`` is the row of the main chunk. Only masks that a later chunk can still read or change are held, about one chunk of
    them; the others are handed on as they are done. A frame without foreground gives an empty run.
    """
    step = check_chunking(size, overlap)
    vid, total, main = row["vid"].iloc[0], int(row["num_frames"].iloc[0]), int(row["main_chunk"].iloc[0])
    last = -(-max(total - size, 0) // step)

    def masks(at: pd.DataFrame) -> Masks:
        out = apply(at)
        found: Masks = {}
        for part in [out] if isinstance(out, pd.DataFrame) else out:
            part = part.reindex(columns=["vid", "frame_idx", "y", "x0", "x1"])
            part = part[(part["vid"] == vid) & part["frame_idx"].notna()]
            for frame, y, x0, x1 in zip(*(pd.to_numeric(part[c]).tolist() for c in ("frame_idx", "y", "x0", "x1")), strict=True):
                runs = found.setdefault(int(frame), [])
                if x1 > x0:
                    runs.append((int(y), int(x0), int(x1)))
        return {frame: _sweep(runs, 1) for frame, runs in found.items()}

    def rows(done: Masks) -> Iterator[pd.DataFrame]:
        cells = [(vid, frame, *run) for frame, runs in done.items() for run in runs or [(0, 0, 0)]]
        if cells:
            yield pd.DataFrame(cells, columns=["vid", "frame_idx", "y", "x0", "x1"])

    live, aside = masks(row), {}
    after = (main + 1) * step if main < last else math.inf
    for backward in (True, False):
        for chunk in range(main - 1, -1, -1) if backward else range(main + 1, last + 1):
            start = chunk * step
            over = {f: m for f, m in live.items() if (f >= start + size if backward else f < start)}
            live = {f: m for f, m in live.items() if f not in over}
            aside |= {f: m for f, m in over.items() if backward and f >= after}
            yield from rows({f: m for f, m in over.items() if not (backward and f >= after)})
            boundary = start + step if backward else min(start - step + size, total)
            prompt_idx = boundary if backward else boundary - 1
            if not live:
                break
            if prompt_idx not in live:
                continue
            at = row.assign(chunk_id=chunk, chunk_start=start, chunk_end=min(start + size, total), prompt_idx=prompt_idx)
            prompt = [dict(zip(("y", "x0", "x1"), run, strict=True)) for run in live[prompt_idx]]
            at["prompt"] = pd.Series([np.array(prompt, dtype=object) if prompt else None], index=at.index, dtype=object)
            for frame, new in masks(at).items():
                live[frame] = _chosen(live[frame], new, frame, boundary, backward, overlap) if frame in live else new
        if backward:
            live |= aside
    yield from rows(live)


Propagate = Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]

_FRAME_COLS = ["vid", "frame_idx", "height", "width"]
_SPAN_COLS = ["vid", "frame_idx", "y", "x0", "x1"]
_CARRY = ["num_frames", "main_chunk"]


def propagate_in_chunks(
    clips: DataFrame,
    prompt_frames: DataFrame,
    prompt_spans: DataFrame,
    propagate: Propagate,
    size: int,
    overlap: int,
) -> tuple[DataFrame, DataFrame]:
    """Propagate long clips chunk by chunk outward from the main chunk.

    Chunks depend on their neighbour, clips do not: wave ``k`` handles the chunk ``k`` steps away from the main
    chunk of all clips in one job, first toward the start, then toward the end. A chunk is prompted with the merged
    mask at its boundary frame and skipped if that frame has no mask. Only frames the next wave can still read or
    change stay in the loop, so a wave costs one chunk per clip, and a direction ends as soon as no frame is left in it.
    A wave writes its frames and its runs once, what is over apart from what goes on; so neither lineage nor a lost
    executor makes earlier waves run again. What is over stays where it was written and is read once at the end; what
    went on is removed when the next wave is written.

    ``clips`` has ``vid, num_frames, key_frame_idx``; prompts hold the mask at the key frame. ``propagate(chunks,
    frames, spans)`` gets chunk rows (``vid, chunk_id, chunk_start, chunk_end, prompt_idx``) with prompt masks and
    returns mask frames and canonical runs keyed by ``vid, frame_idx``, with frame numbers of the clip.

    A propagator of single rows (one with ``along``) needs no wave: each clip walks through its chunks in one task, which holds
    about a chunk of masks (:func:`walk_chunks`), so the number of jobs does not grow with the length of a clip.
    """
    total, frame = F.col("num_frames"), F.col("frame_idx")
    main = cut_lineage(
        clips.select(
            "vid",
            "num_frames",
            "key_frame_idx",
            main_chunk(F.col("key_frame_idx"), total, size, overlap).alias("main_chunk"),
        ).filter("main_chunk IS NOT NULL")
    )
    last = chunk_count(total, size, overlap) - 1
    before, after = main.agg(F.max("main_chunk"), F.max(last - F.col("main_chunk"))).first()
    if before is None:
        return prompt_frames.select(*_FRAME_COLS).limit(0), prompt_spans.select(*_SPAN_COLS).limit(0)

    def chunk_rows(rows: DataFrame, chunk: Column, prompt_idx: Column) -> DataFrame:
        return rows.select(
            "vid",
            *_CARRY,
            chunk.alias("chunk_id"),
            chunk_start(chunk, size, overlap).alias("chunk_start"),
            chunk_end(chunk, total, size, overlap).alias("chunk_end"),
            prompt_idx.alias("prompt_idx"),
        )

    first = chunk_rows(main, F.col("main_chunk"), F.col("key_frame_idx"))
    if hasattr(propagate, "along"):
        frames, spans = propagate.along(lambda apply, row: walk_chunks(apply, row, size, overlap), first, prompt_frames, prompt_spans)
        return frames.select(*_FRAME_COLS), spans.select(*_SPAN_COLS)
    frames, spans = propagate(first, prompt_frames, prompt_spans)
    place = main.select("vid", *_CARRY)
    spark = clips.sparkSession
    work = shared_folder(spark, "chunks")
    frames = join_by_group(frames.select(*_FRAME_COLS), place, ["vid"], ["frame_idx"])
    spans = join_by_group(spans.select(*_SPAN_COLS), place, ["vid"], ["frame_idx", "y", "x0"])

    def step(wave: int, backward: bool) -> tuple[Column, Column]:
        """The chunk of a wave, and the frames that it can meet; they include its prompt frame."""
        chunk = F.col("main_chunk") + F.lit(-wave if backward else wave)
        start = chunk_start(chunk, size, overlap)
        return chunk, (chunk >= 0) & (chunk <= last) & ((frame < start + size) if backward else (frame >= start))

    def stored(rows: DataFrame, folder: str, live: Column) -> DataFrame:
        """Rows written with what is over (1) apart from what goes on (0), and all read back."""
        told = rows.withColumn("over", F.when(live, 0).otherwise(1))
        told.write.partitionBy("over").parquet(folder)
        return spark.read.schema(told.schema).parquet(folder)

    def goes_on(rows: DataFrame) -> DataFrame:
        return rows.filter("over = 0").drop("over")

    for backward, waves in ((True, before), (False, after)):
        if not waves and not backward:
            continue
        home = f"{work}/{'back' if backward else 'on'}"
        live = step(1, backward)[1] if waves else F.lit(False)
        frames = stored(frames, f"{home}-f/wave=0", live)
        spans = stored(spans, f"{home}-s/wave=0", live)
        kinds = frames.schema, spans.schema
        frames, spans = goes_on(frames), goes_on(spans)
        for wave in range(1, waves + 1):
            if frames.isEmpty():
                break
            chunk, _ = step(wave, backward)
            live = step(wave + 1, backward)[1] if wave < waves else F.lit(False)
            if backward:
                boundary = chunk_start(chunk + 1, size, overlap)
                prompt_idx = boundary
            else:
                boundary = chunk_end(chunk - 1, total, size, overlap)
                prompt_idx = boundary - 1
            at = frames.filter(frame == prompt_idx)
            ready = chunk_rows(at, chunk, prompt_idx)
            new_f, new_s = propagate(ready, at.select(*_FRAME_COLS), spans.filter(frame == prompt_idx).select(*_SPAN_COLS))
            edges = at.select("vid", *_CARRY, boundary.alias("boundary"), F.lit(backward).alias("backward"))
            new_f = join_by_group(new_f.select(*_FRAME_COLS), edges, ["vid"], ["frame_idx"])
            here = f"{home}-f/wave={wave}"
            _, spans = merge_chunk_masks(
                frames, spans, new_f, new_s.select(*_SPAN_COLS), overlap, carry=_CARRY,
                settle=lambda df, to=here, live=live: stored(df, to, live),
            )
            frames = goes_on(spark.read.schema(kinds[0]).parquet(here))
            spans = goes_on(stored(spans, f"{home}-s/wave={wave}", live))
            for side in ("f", "s"):
                remove_folder(spark, f"{home}-{side}/wave={wave - 1}/over=0")
        ended = (spark.read.schema(kind).parquet(f"{home}-{side}") for kind, side in zip(kinds, "fs", strict=True))
        frames, spans = (rows.filter("over = 1").drop("over") for rows in ended)
    return frames.select(*_FRAME_COLS), spans.select(*_SPAN_COLS)
