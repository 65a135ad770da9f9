"""Frame sampling and the key-frame pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgrid.operators.skew import number_rows, unfold, with_group_stats

SOURCE_FPS = 30.0
TARGET_FPS = 3.0


def _positive(value: Column, default: float) -> Column:
    number = value.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number).otherwise(F.lit(default))


def source_fps(value: Column) -> Column:
    """Source rate; 30 when null, unreadable or not positive."""
    return _positive(value, SOURCE_FPS)


def target_fps(value: Column) -> Column:
    """Sampling rate; 3 when null, unreadable or not positive."""
    return _positive(value, TARGET_FPS)


def sample_count(length: Column, fps_source: Column, fps_target: Column) -> Column:
    """Frames to sample from a clip: duration times rate, rounded half to even, at least 1, at most ``length``."""
    wanted = F.rint(length.cast("double") / fps_source * fps_target)
    return F.least(length.cast("long"), F.greatest(F.lit(1).cast("long"), wanted.cast("long")))


def source_index(sample_idx: Column, count: Column, length: Column) -> Column:
    """Source frame of a sample, evenly spaced and rounded half to even; a single sample is the last frame.

    Sample indices outside ``0 .. count-1`` are clamped.
    """
    last = length.cast("long") - 1
    at = F.least(F.greatest(sample_idx, F.lit(0)), count - 1)
    spaced = F.rint(at * (last.cast("double") / F.nullif(count - 1, F.lit(0).cast("long")))).cast("long")
    return F.when(at >= count - 1, last).otherwise(spaced)


def sample_frames(
    clips: DataFrame,
    length: str = "num_frames",
    fps_source: str = "video_fps",
    fps_target: Column | float = TARGET_FPS,
    keys: Sequence[str] = ("vid",),
) -> DataFrame:
    """One row per sampled frame: ``sample_idx`` and the ``frame_idx`` in the source."""
    rate = fps_target if isinstance(fps_target, Column) else F.lit(float(fps_target))
    counted = clips.withColumn(
        "num_sampled_frames", sample_count(F.col(length), source_fps(F.col(fps_source)), target_fps(rate))
    )
    rows = unfold(counted, F.col("num_sampled_frames"), "sample_idx", keys)
    return rows.withColumn("frame_idx", source_index(F.col("sample_idx"), F.col("num_sampled_frames"), F.col(length)))


def pick_key_frames(
    scores: DataFrame,
    keys: Sequence[str] = ("vid",),
    score: str = "score",
    sample_idx: str = "sample_idx",
    carry: Sequence[str] = ("frame_idx",),
) -> DataFrame:
    """Best sample per clip with sample count and score statistics; the earliest sample wins a tie.

    One aggregation with map-side combine: nothing is sorted or gathered per clip.
    """
    kept = F.struct(F.col(sample_idx).alias("sample_idx"), *[F.col(c) for c in carry])
    rank = F.struct(F.col(score), (-F.col(sample_idx)).alias("earliest"))
    best = scores.groupBy(*keys).agg(
        F.max_by(kept, rank).alias("_best"),
        F.count(F.lit(1)).alias("num_sampled_frames"),
        F.max(score).alias("max_similarity"),
        F.min(score).alias("min_similarity"),
        F.avg(score).alias("mean_similarity"),
    )
    return best.select(
        *keys,
        F.col("_best.sample_idx").alias("key_frame_idx"),
        *[F.col(f"_best.{c}").alias(c) for c in carry],
        "num_sampled_frames",
        "max_similarity",
        "min_similarity",
        "mean_similarity",
    )


def normalise_by_group(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    constant: float,
    spread: Sequence[str],
    salts: int | None = None,
) -> DataFrame:
    """Min-max scale ``value`` per group; a constant group gives ``constant`` (0.5 for scores, 0 for maps)."""
    stats = [F.min(value).alias("_low"), F.max(value).alias("_high")]
    extent = F.col("_high") - F.col("_low")
    scaled = (F.col(value) - F.col("_low")) / extent
    # Scores count as constant below 1e-8, maps at or below it.
    varies = extent > 1e-8 if constant == 0 else extent >= 1e-8
    if salts == 1:  # a bounded group
        group = Window.partitionBy(*keys)
        ranged = rows.withColumns({"_low": F.min(value).over(group), "_high": F.max(value).over(group)})
    else:
        ranged = with_group_stats(rows, keys, stats, spread, salts)
    return ranged.withColumn(name, F.when(varies, scaled).otherwise(F.lit(constant))).drop("_low", "_high")


def number_sentences(
    clips: DataFrame,
    keys: Sequence[str] = ("vid",),
    order: Sequence[str] | None = None,
    segment: Column | None = None,
    name: str = "sentence_index",
) -> DataFrame:
    """Number the sentences of a video from 1 in input order: file, block, position, kind, place in its list.

    Numbers are given before finished work is removed, so they stay the same from run to run; file and block come
    first, as positions alone follow how files are packed into tasks.
    """
    if order is None:
        order = [c for c in ("ann_file", "ann_block", "ann_pos", "kind", "cap_pos") if c in clips.columns]
    if segment is None and "ann_pos" in order:
        lead = [F.col(c) for c in order[: order.index("ann_pos")]]
        segment = F.struct(*lead, F.floor(F.col("ann_pos") / 4096).alias("_part"))
    cut = segment if segment is not None else F.floor(F.col(order[0]) / 4096)
    return number_rows(clips, keys, [F.col(c) for c in order], cut, name)
