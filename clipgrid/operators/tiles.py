"""Overlap of many masks with many boxes on one frame, by tiles of the image."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.boxes import clamp_box
from clipgrid.operators.skew import join_by_group, not_broadcast
from clipgrid.operators.spans import MASK_KEYS, rectangles

_AT = ["vid", "frame_idx"]
_TILE = ["_ty", "_tx"]
_EXTENT = ["_top", "_bottom", "_left", "_right"]
#: Rectangles and tiles up to which a mask travels whole to each of its tiles.
WHOLE_RUNS, WHOLE_TILES = 64, 16
FEW_RUNS = 4


def _tiles(begin: str, end: str, size: int) -> Column:
    """The tiles that a half-open range of at least one pixel touches."""
    return F.explode(F.sequence(F.floor(F.col(begin) / size), F.floor((F.col(end) - 1) / size)))


def _placed(boxes: DataFrame, box: str, tile: tuple[int, int]) -> DataFrame:
    """Every box that holds a pixel, once per tile that it touches."""
    height, width = tile
    whole = boxes.select(*_AT, box, "xmin", "ymin", "xmax", "ymax").filter("xmax > xmin AND ymax > ymin")
    return whole.withColumn("_ty", _tiles("ymin", "ymax", height)).withColumn("_tx", _tiles("xmin", "xmax", width))


def meetings(spans: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, tile: tuple[int, int]) -> DataFrame:
    """Runs and boxes of one tile of one frame, the run cut to the tile.

    ``boxes`` has whole-number corners inside the image. A pixel lies in one tile, so what is shared in several tiles can
    be summed and nothing counts twice.
    """
    height, width = tile
    cut = spans.filter("x1 > x0").withColumn("_ty", F.floor(F.col("y") / height)).withColumn("_tx", _tiles("x0", "x1", width))
    left = F.greatest(F.col("x0"), F.col("_tx") * width).alias("_x0")
    right = F.least(F.col("x1"), (F.col("_tx") + 1) * width).alias("_x1")
    cut = cut.select(*keys, *_TILE, "y", left, right)
    return cut.join(not_broadcast(_placed(boxes, box, tile)), [*_AT, *_TILE])


def tiled_overlaps(
    spans: DataFrame,
    frames: DataFrame,
    boxes: DataFrame,
    box: str = "box_id",
    tile: tuple[int, int] = (64, 64),
    keys: Sequence[str] = MASK_KEYS,
    solid: DataFrame | None = None,
) -> DataFrame:
    """Masks and boxes of a frame that share a pixel: ``keys``, ``box``, ``area``, ``box_pixels``, ``inter``, ``iou``.

    Joining by frame alone makes every run meet every box of it; here they meet in tiles of ``tile`` (height, width)
    pixels only. Runs of a mask that repeat from line to line are taken as one rectangle. A mask of few rectangles and tiles goes whole
    to each tile and is compared there in its row, so its pairs, which may be as many as masks times boxes, are neither shuffled nor
    kept; the rectangles of others travel one by one and what they share is summed. Boxes are cut to the image first, so a box has at
    most as many tiles as the image. Boxes that are null or hold no pixel of the image, and masks that no box meets, give
    no row. ``spans`` are canonical masks of ``keys``, among them ``vid`` and ``frame_idx``; ``frames`` has the image size
    of each mask; ``boxes`` has one ``bbox`` per ``vid, frame_idx`` and ``box``. ``solid`` are further masks of ``keys``, each a
    single rectangle ``y0, y1, x0, x1`` (see :func:`clipgrid.operators.spans.solid_masks`).
    """
    if min(tile) < 1:
        raise ValueError(f"tiles need at least one pixel, got {tile}")
    sizes = frames.groupBy(*_AT).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    sized = join_by_group(boxes.select(*_AT, box, "bbox"), sizes, _AT, [box])
    inside = sized.select(*_AT, box, clamp_box(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox")).select(*_AT, box, "bbox.*")
    high, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    masks = rectangles(spans, keys).groupBy(*keys).agg(
        F.sum(high * wide).cast("long").alias("area"),
        F.collect_list(F.struct("y0", "y1", "x0", "x1")).alias("_parts"),
        F.min("y0").alias("_top"), F.max("y1").alias("_bottom"), F.min("x0").alias("_left"), F.max("x1").alias("_right"),
    )
    height, width = tile
    across = F.floor((F.col("_right") - 1) / width) - F.floor(F.col("_left") / width) + 1
    down = F.floor((F.col("_bottom") - 1) / height) - F.floor(F.col("_top") / height) + 1
    small = (F.size("_parts") <= WHOLE_RUNS) & (across * down <= WHOLE_TILES)
    one = small & (F.size("_parts") == 1)
    plain = masks.filter(one).drop("_parts")
    if solid is not None:
        sides = [F.col(side).cast("long").alias(name) for side, name in zip(("y0", "y1", "x0", "x1"), _EXTENT, strict=True)]
        plain = solid.filter((high > 0) & (wide > 0)).select(*keys, (high * wide).cast("long").alias("area"), *sides).unionByName(plain)
    pairs = (
        _solid_pairs(plain, inside, keys, box, tile)
        .unionByName(_whole_pairs(masks.filter(small & ~one), inside, keys, box, tile))
        .unionByName(_summed_pairs(masks.filter(~small), inside, keys, box, tile))
    )
    iou = F.col("inter") / (F.col("area") + F.col("box_pixels") - F.col("inter"))
    return pairs.select(*keys, box, "area", "box_pixels", "inter", iou.alias("iou"))


def _pixels() -> Column:
    return (F.col("xmax") - F.col("xmin")).cast("long") * (F.col("ymax") - F.col("ymin"))


def _shared(top: Column, bottom: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """Lines and columns that a rectangle shares with the box; none where one of them is not positive."""
    return F.least(bottom, "ymax") - F.greatest(top, "ymin"), F.least(right, "xmax") - F.greatest(left, "xmin")


def _meet(masks: DataFrame, boxes: DataFrame, box: str, tile: tuple[int, int]) -> DataFrame:
    """Rectangles and boxes that share a pixel: each pair is found in one tile, that of the first corner of what they share.

    A crowded tile compares each with each, so what is compared there is plain numbers only. Frame and tile are two hashes of 64 bits:
    rows are sorted by one, in a fraction of the time of names, and the other tells apart what might share it. ``boxes`` have no
    null frame.
    """
    height, width = tile
    names = [*_AT, *_TILE]
    cell, also = F.xxhash64(*names), F.xxhash64(*reversed(names))
    # Both extents touch the tile, so what they share begins in it unless both begin before it.
    first = [
        F.when(F.col(begin) >= F.col(at) * size, F.lit(0).cast("long")).otherwise(F.col(at) * size).alias(name)
        for begin, at, size, name in (("_top", "_ty", height, "_from_y"), ("_left", "_tx", width, "_from_x"))
    ]
    cut = masks.withColumn("_ty", _tiles("_top", "_bottom", height)).withColumn("_tx", _tiles("_left", "_right", width))
    cut = cut.select(*masks.columns, cell.alias("_cell"), also.alias("_also"), *first)
    sides = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    placed = _placed(boxes, box, tile).select(cell.alias("_cell"), also.alias("_box_also"), box, *sides)
    meet = (
        (F.col("ymin") >= F.col("_from_y")) & (F.col("ymin") < F.col("_bottom")) & (F.col("ymax") > F.col("_top"))
        & (F.col("xmin") >= F.col("_from_x")) & (F.col("xmin") < F.col("_right")) & (F.col("xmax") > F.col("_left"))
    )
    # An equality would make the second hash one more column to sort by.
    same = (F.col("_also") <= F.col("_box_also")) & (F.col("_also") >= F.col("_box_also"))
    return cut.join(not_broadcast(placed), "_cell").filter(meet & same)


def _solid_pairs(masks: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, tile: tuple[int, int]) -> DataFrame:
    """Pairs of rectangles. Their corners are all there is to compare, which Spark makes part of the join's own loop, in code that is
    short enough for the JVM to compile.
    """
    high, wide = _shared(*map(F.col, _EXTENT))
    inter = (high * wide).cast("long").alias("inter")
    return _meet(masks, boxes, box, tile).select(*keys, box, "area", _pixels().alias("box_pixels"), inter)


def _whole_pairs(masks: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, tile: tuple[int, int]) -> DataFrame:
    """Pairs of masks of several rectangles that travel whole."""
    none = F.lit(0).cast("long")

    def shared(part: Column) -> Column:
        high, wide = _shared(part["y0"], part["y1"], part["x0"], part["x1"])
        # Least and greatest pass over nulls, so a part that is missing must be told apart.
        return F.when(part.isNotNull() & (high > 0) & (wide > 0), (high * wide).cast("long")).otherwise(none)

    # The usual mask of few rectangles is a plain sum, which costs a fraction of an aggregate over the array.
    few = reduce(add, (shared(F.get("_parts", F.lit(i))) for i in range(FEW_RUNS)))
    inter = F.when(F.size("_parts") <= FEW_RUNS, few).otherwise(F.aggregate("_parts", none, lambda total, part: total + shared(part)))
    met = _meet(masks, boxes, box, tile)
    return met.select(*keys, box, "area", _pixels().alias("box_pixels"), inter.alias("inter")).filter("inter > 0")


def _summed_pairs(masks: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, tile: tuple[int, int]) -> DataFrame:
    """Pairs of masks whose rectangles travel one by one; what is shared is summed over them."""
    sides = [F.col(f"_part.{side}").alias(name) for side, name in zip(("y0", "y1", "x0", "x1"), _EXTENT, strict=True)]
    parts = masks.select(*keys, "area", F.explode("_parts").alias("_part")).select(*keys, "area", *sides)
    shared = _solid_pairs(parts, boxes, keys, box, tile)
    return shared.groupBy(*keys, box, "area", "box_pixels").agg(F.sum("inter").cast("long").alias("inter"))
