"""Row checks that name every problem, with a choice between failing and setting rows aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrid.functions.boxes import box_error
from clipgrid.functions.text import is_blank
from clipgrid.schemas import PROPAGATION_REQUIRED


def missing_fields(rows: DataFrame, required: Sequence[str]) -> Column:
    """Comma-separated names of the required columns that are null or blank text; null when complete."""
    absent = []
    for name in required:
        column = F.col(name)
        empty = is_blank(column) if isinstance(rows.schema[name].dataType, T.StringType) else column.isNull()
        absent.append(F.when(empty, F.lit(name)))
    return F.nullif(F.concat_ws(", ", *absent), F.lit(""))


def propagation_error(rows: DataFrame, require_bbox: bool = True) -> Column:
    """Why a joined row cannot be propagated: null when it can.

    A missing video path or frame index always counts, the other required fields only with ``require_bbox``.
    """
    always = missing_fields(rows, ("video_path", "key_frame_idx"))
    if not require_bbox:
        # Without the box check a blank path is accepted, only an absent one is not.
        return F.nullif(
            F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n in ("video_path", "key_frame_idx")]),
            F.lit(""),
        )
    return F.coalesce(missing_fields(rows, PROPAGATION_REQUIRED), always, box_error(F.col("bbox")))


def require_valid(rows: DataFrame, error: Column, key: str = "vid") -> DataFrame:
    """Fail the job at the first row with an error, naming the row."""
    message = F.concat(F.col(key).cast("string"), F.lit(": missing or invalid "), F.col("_error"))
    return (
        rows.withColumn("_error", error)
        .filter(F.when(F.col("_error").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
        .drop("_error")
    )


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``error``."""
    tagged = rows.withColumn("error", error)
    return tagged.filter("error IS NULL").drop("error"), tagged.filter("error IS NOT NULL")


def in_range(index: Column, length: Column) -> Column:
    """``0 <= index < length``."""
    return (index >= 0) & (index < length)


def usable_grounding() -> Column:
    """Grounding succeeded and has a box."""
    return F.coalesce(F.col("success"), F.lit(False)) & F.col("bbox").isNotNull()


def too_long(num_frames: Column, cap: int) -> Column:
    return num_frames > cap


def needs_chunks(num_frames: Column, width: Column, height: Column, max_frames: int, max_memory_mb: float) -> Column:
    """More frames, or more memory at four bytes per pixel, than one pass takes."""
    memory = num_frames.cast("double") * width * height * 4 / (1024 * 1024)
    return (num_frames > max_frames) | (memory > max_memory_mb)
