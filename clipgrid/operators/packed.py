"""Masks as one row each: an array of rectangles that do not overlap.

Equal runs of neighbouring lines are one rectangle ``y0 <= y < y1, x0 <= x < x1``. Area, extent and overlap are sums over the array
inside the row, so nothing is unfolded, joined or shuffled for them. A mask is bounded by the pixels of its image, and so is a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgrid.functions.boxes import clamp_box_for_iou
from clipgrid.operators.skew import join_by_key, not_broadcast
from clipgrid.operators.spans import union_runs
from clipgrid.schemas import MASK_KEYS

RECT = "struct<y0:int,y1:int,x0:int,x1:int>"


def _zero() -> Column:
    return F.lit(0).cast("long")


def pack_masks(spans: DataFrame, frames: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """keys, height, width, rects of every mask in ``frames``; an empty mask has no rectangles. ``spans`` are canonical."""
    key = list(keys)
    same = [*key, "x0", "x1"]
    stacked = F.col("y") - F.row_number().over(Window.partitionBy(*same).orderBy("y"))
    rects = (
        spans.withColumn("_stack", stacked)
        .groupBy(*same, "_stack")
        .agg(F.min("y").cast("int").alias("y0"), (F.max("y") + 1).cast("int").alias("y1"))
        .withColumns({"x0": F.col("x0").cast("int"), "x1": F.col("x1").cast("int")})
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("y0", "y1", "x0", "x1"))).alias("rects"))
    )
    none = F.array().cast(f"array<{RECT}>")
    sized = frames.select(*key, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    joined = sized.join(not_broadcast(rects), key, "left")
    return joined.select(*key, "height", "width", F.coalesce("rects", none).alias("rects"))


def unpack_masks(packed: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """The runs of packed masks."""
    lines = packed.select(*keys, F.explode("rects").alias("_r"))
    lines = lines.select(*keys, F.explode(F.sequence(F.col("_r.y0"), F.col("_r.y1") - 1)).alias("y"), "_r")
    return lines.select(*keys, F.col("y").cast("long").alias("y"), F.col("_r.x0").cast("long").alias("x0"), F.col("_r.x1").cast("long").alias("x1"))


def area(rects: Column) -> Column:
    return F.aggregate(rects, _zero(), lambda s, r: s + (r["y1"] - r["y0"]).cast("long") * (r["x1"] - r["x0"]))


def _shared(r: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    lines = F.greatest(F.lit(0), F.least(r["y1"], y1) - F.greatest(r["y0"], y0)).cast("long")
    return lines * F.greatest(F.lit(0), F.least(r["x1"], x1) - F.greatest(r["x0"], x0))


def area_in_box(rects: Column, box: Column) -> Column:
    """Pixels of a mask inside a box, half open on both axes."""
    ends = [box[c].cast("int") for c in ("ymin", "ymax", "xmin", "xmax")]
    return F.aggregate(rects, _zero(), lambda s, r: s + _shared(r, *ends))


def shared_area(left: Column, right: Column) -> Column:
    """Pixels that two masks share."""

    def with_right(total: Column, a: Column) -> Column:
        return total + F.aggregate(right, _zero(), lambda s, b: s + _shared(a, b["y0"], b["y1"], b["x0"], b["x1"]))

    return F.aggregate(left, _zero(), with_right)


def joint_area(left: Column, right: Column) -> Column:
    """Pixels that either of two masks has."""
    return area(left) + area(right) - shared_area(left, right)


def packed_stats(packed: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Area, coverage in percent and inclusive extent of packed masks, as ``mask_stats`` gives them for runs."""
    size = area(F.col("rects"))
    least = lambda c: F.array_min(F.transform("rects", lambda r: r[c]))
    most = lambda c: F.array_max(F.transform("rects", lambda r: r[c])) - 1
    pixels = F.col("height").cast("long") * F.col("width")
    return packed.select(
        *keys,
        size.alias("area"),
        (F.try_divide(size, pixels) * 100).alias("coverage"),
        least("x0").alias("xmin"),
        least("y0").alias("ymin"),
        most("x1").alias("xmax"),
        most("y1").alias("ymax"),
    )


def packed_box_iou(packed: DataFrame, boxes: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """keys, area, inter, box_pixels and iou of every packed mask on a box's frame; 0 for a degenerate box."""
    at = ["vid", "frame_idx"]
    met = join_by_key(packed, boxes.select(*at, "bbox"), at)
    box = clamp_box_for_iou(F.col("bbox"), F.col("width"), F.col("height"))
    sides = F.greatest(F.lit(0), box["xmax"] - box["xmin"]).cast("long") * F.greatest(F.lit(0), box["ymax"] - box["ymin"])
    sums = met.select(*keys, area(F.col("rects")).alias("area"), area_in_box(F.col("rects"), box).alias("inter"), sides.alias("box_pixels"))
    union = F.col("area") + F.col("box_pixels") - F.col("inter")
    return sums.withColumn("iou", F.when((F.col("box_pixels") > 0) & (union > 0), F.col("inter") / union).otherwise(F.lit(0.0)))


def unite_packed(packed: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """One packed mask per key from several of the same image."""
    frames = packed.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    return pack_masks(union_runs(unpack_masks(packed, keys), keys), frames, keys)
