"""What is left to do: four policies for finished work, limits before and after, request batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.names import base_vid, clip_idx
from clipgrid.operators.skew import number_rows

# The files a finished key frame consists of.
KEY_FRAME_FILES = ("metadata.json", "key_frame.png", "similarity_scores.npy")


def drop_finished_key_frames(
    clips: DataFrame, files: DataFrame, keys: Sequence[str] = ("vid", "sentence_index")
) -> DataFrame:
    """Clips lacking any of the three key-frame files. ``files`` has the keys and a file ``name``."""
    finished = (
        files.filter(F.col("name").isin(*KEY_FRAME_FILES))
        .groupBy(*keys)
        .agg(F.countDistinct("name").alias("_files"))
        .filter(F.col("_files") == len(KEY_FRAME_FILES))
    )
    return clips.join(finished, list(keys), "left_anti")


def drop_grounded(clips: DataFrame, grounding: DataFrame, force: bool = False) -> DataFrame:
    """Clips without any grounding row, successful or not; ``force`` keeps all."""
    return clips if force else clips.join(grounding, "vid", "left_anti")


def drop_succeeded(clips: DataFrame, outcomes: DataFrame, masks: DataFrame) -> DataFrame:
    """Clips without a success that has its mask; failures are always tried again."""
    done = outcomes.filter(F.coalesce(F.col("success"), F.lit(False))).join(masks, "vid", "left_semi")
    return clips.join(done, "vid", "left_anti")


def drop_by_status(clips: DataFrame, outcomes: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Clips without a success that has masks; failed ones are skipped too unless ``retry_failed``."""
    done = (F.coalesce(F.col("status"), F.lit("unknown")) != "failed") & (F.coalesce("num_masks", F.lit(0)) > 0)
    if not retry_failed:
        done = done | (F.col("status") == "failed")
    return clips.join(outcomes.filter(done), "vid", "left_anti")


def take_first(clips: DataFrame, limit: int | None, numeric: bool = True) -> DataFrame:
    """The first clips by video and sentence number, or by the text of the identifier.

    Sort and limit together keep only ``limit`` rows per task.
    """
    if limit is None:
        return clips
    vid = F.col("vid")
    # A scan knows which part is the number; a bare identifier is split at its last underscore.
    placed = {"base_vid", "idx"} <= set(clips.columns)
    base, idx = (F.col("base_vid"), F.col("idx")) if placed else (base_vid(vid), clip_idx(vid))
    order = [base, idx.try_cast("long"), vid] if numeric else [vid]
    return clips.orderBy(*order).limit(limit)


def limit_then_drop(clips: DataFrame, limit: int | None, grounding: DataFrame, force: bool = False) -> DataFrame:
    """Take the first clips, then remove finished ones: a second run of the same limit has nothing to do."""
    return drop_grounded(take_first(clips, limit), grounding, force)


def drop_then_limit(
    clips: DataFrame, limit: int | None, outcomes: DataFrame, retry_failed: bool = False
) -> DataFrame:
    """Remove finished clips, then take the first: a second run goes on with the next ones."""
    return take_first(drop_by_status(clips, outcomes, retry_failed), limit, numeric=False)


def request_batches(rows: DataFrame, size: int, buckets: int = 64, key: str = "vid", bucket: Column | None = None) -> DataFrame:
    """Number rows into batches of at most ``size`` per bucket: ``bucket``, ``batch_id``.

    The bucket is a hash of the key, or a column of the caller (a device, a customer). Order inside a bucket follows the hash of the key, whose leading bits cut it into small segments.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    hashed = rows.withColumn("_hash", F.xxhash64(key)).withColumn(
        "bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int") if bucket is None else bucket
    )
    segment = F.shiftright(F.col("_hash"), 48)
    numbered = number_rows(hashed, ["bucket"], [F.col("_hash"), F.col(key)], segment, "_n", start=0)
    return numbered.withColumn("batch_id", F.floor(F.col("_n") / size)).drop("_hash", "_n")
