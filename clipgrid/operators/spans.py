"""Binary masks as runs of pixels.

A mask is a set of rows ``(vid, tube_id, frame_idx, y, x0, x1)``: the pixels ``x0 <= x < x1`` of line ``y`` are set.
``mask_frames`` holds one row per mask with its height and width, so an empty mask still exists. Area, overlap and
extent are plain aggregates; union, intersection, dilation and erosion all come from a sweep along a line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgrid.operators.skew import not_broadcast
from clipgrid.schemas import MASK_KEYS


def covered_runs(
    spans: DataFrame, line: Sequence[str], need: Column, together: Sequence[str] | None = None
) -> DataFrame:
    """Maximal runs of every line that at least ``need`` of the given runs cover.

    Run ends are summed per position before the sweep, with map-side combine, so a line holds at most one row per
    pixel column however many copies of a run come in. ``need`` may use the columns of ``line``. ``together`` names
    the columns to distribute the result by, when what follows works on whole masks; it must be part of ``line``.
    """
    ends = (
        spans.filter(F.col("x1") > F.col("x0"))
        .select(
            *line,
            F.explode(
                F.array(
                    F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")),
                    F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step")),
                )
            ).alias("_end"),
        )
        .select(*line, "_end.x", "_end.step")
        .groupBy(*line, "x")
        .agg(F.sum("step").alias("step"))
    )
    if together:
        ends = ends.repartition(*together)
    along = Window.partitionBy(*line).orderBy("x")
    # Positions are unique per line, so the depth just before one is its depth without its own step.
    return (
        ends.withColumn("_depth", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_inside", F.col("_depth") >= need)
        .filter(F.col("_inside") != (F.col("_depth") - F.col("step") >= need))
        .withColumn("_next", F.lead("x").over(along))
        .filter("_inside")
        .select(*line, F.col("x").alias("x0"), F.col("_next").alias("x1"))
    )


def joined_runs(spans: DataFrame, line: Sequence[str], together: Sequence[str] | None = None) -> DataFrame:
    """The same for ``need`` = 1, with half the rows: runs are joined while they begin within what came before.

    Of the runs that begin at one position the longest is found on the map side first.
    """
    runs = spans.filter(F.col("x1") > F.col("x0")).groupBy(*line, "x0").agg(F.max("x1").alias("x1"))
    if together:
        runs = runs.repartition(*together)
    along = Window.partitionBy(*line).orderBy("x0")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, 0))
    # One order serves all steps, so no table of runs is built beside it. A run begins beyond the reach of what came before and
    # ends at the reach of its last row, the one before the next run or before the end of the line.
    return (
        runs.withColumns({"_reach": reach, "_so_far": so_far, "_follows": F.lead("x0").over(along)})
        .withColumn("_begins", F.col("_reach").isNull() | (F.col("x0") > F.col("_reach")))
        .withColumn("_ends", F.col("_follows").isNull() | (F.col("_follows") > F.col("_so_far")))
        .filter("_begins OR _ends")
        .withColumn("x1", F.when(F.col("_ends"), F.col("_so_far")).otherwise(F.lead("_so_far").over(along)))
        .filter("_begins")
        .select(*line, "x0", "x1")
    )


def union_runs(spans: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Canonical masks: overlapping and touching runs of a line become one.

    The result is distributed by mask, so joins and aggregates per mask need no further shuffle. A canonical mask
    is bounded by the pixels of its image; a hot clip is spread over its frames.
    """
    return joined_runs(spans, [*keys, "y"], together=keys)


def solid_masks(rects: DataFrame, keys: Sequence[str] = MASK_KEYS) -> tuple[DataFrame, DataFrame]:
    """Masks given as any number of rectangles ``y0, y1, x0, x1``: those of a single one as it is, and canonical runs of the others.

    A mask of a single rectangle is canonical already and needs no lines. Ends are found with map-side combine, so copies of a
    rectangle make no mask larger. Rows with a null key belong to no mask.
    """
    sides = ["y0", "y1", "x0", "x1"]
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    held = rects.filter("y1 > y0 AND x1 > x0").filter(known).select(*keys, *sides)
    ends = held.groupBy(*keys).agg(*[F.min(s).alias(s) for s in sides], *[F.max(s).alias(f"_{s}") for s in sides])
    single = reduce(and_, (F.col(s) == F.col(f"_{s}") for s in sides))
    several = held.join(ends.filter(~single).select(*keys), list(keys), "left_semi")
    # Dealt by rectangle: a mask of many is unfolded by many tasks, and what reads the runs more than once does not join again.
    lines = several.repartition(*keys, *sides).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    return ends.filter(single).select(*keys, *sides), union_runs(lines.select(*keys, "y", "x0", "x1"), keys)


def rectangles(spans: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Canonical runs as disjoint rectangles ``y0, y1, x0, x1``: equal runs on consecutive lines become one."""
    column = [*keys, "x0", "x1"]
    island = F.col("y") - F.row_number().over(Window.partitionBy(*column).orderBy("y"))
    return (
        spans.filter("x1 > x0")
        .withColumn("_island", island)
        .groupBy(*column, "_island")
        .agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
        .select(*keys, "y0", "y1", "x0", "x1")
    )


def intersect_runs(left: DataFrame, right: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Pixels set in both of two canonical masks."""
    columns = [*keys, "y", "x0", "x1"]
    both = left.select(*columns).unionByName(right.select(*columns))
    return covered_runs(both, [*keys, "y"], F.lit(2))


def pixels_to_runs(pixels: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Runs of the distinct set pixels ``(keys, y, x)``."""
    line = [*keys, "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*line).orderBy("x"))
    return (
        pixels.select(*line, "x")
        .withColumn("_island", island)
        .groupBy(*line, "_island")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
        .drop("_island")
    )


def mask_stats(spans: DataFrame, frames: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Area, coverage in percent and inclusive extent of every canonical mask; an empty mask has area 0, null box."""
    key = list(keys)
    sums = spans.groupBy(*key).agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"),
        F.min("x0").alias("xmin"),
        F.min("y").alias("ymin"),
        (F.max("x1") - 1).alias("xmax"),
        F.max("y").alias("ymax"),
    )
    area = F.coalesce(F.col("area"), F.lit(0))
    return frames.select(*key, "height", "width").join(not_broadcast(sums), key, "left").select(
        *key,
        area.alias("area"),
        (F.try_divide(area, F.col("height") * F.col("width")) * 100).alias("coverage"),
        "xmin",
        "ymin",
        "xmax",
        "ymax",
    )


def box_runs(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filled rectangle of a box, half open on both axes: one run per line; an empty box gives none."""
    box = F.col("bbox")
    x0, y0 = F.greatest(F.lit(0), box["xmin"]), F.greatest(F.lit(0), box["ymin"])
    return (
        boxes.select(*keys, x0.cast("long").alias("x0"), y0.cast("long").alias("_y0"), box["xmax"].cast("long").alias("x1"),
                     box["ymax"].cast("long").alias("_y1"))
        .filter("x1 > x0 AND _y1 > _y0")
        .withColumn("y", F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1)))
        .select(*keys, "y", "x0", "x1")
    )


def box_overlap(spans: DataFrame, box: Column) -> tuple[Column, Column]:
    """Pixels of a run, and those of them inside a box, as columns to be summed per mask."""
    length = F.col("x1") - F.col("x0")
    shared = F.greatest(F.lit(0), F.least(F.col("x1"), box["xmax"]) - F.greatest(F.col("x0"), box["xmin"]))
    in_rows = (F.col("y") >= box["ymin"]) & (F.col("y") < box["ymax"])
    return length, F.when(in_rows, shared).otherwise(F.lit(0))


def resize_runs(spans: DataFrame, to_height: Column, to_width: Column, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Nearest-neighbour resize: a target pixel shows the source pixel ``floor(target * scale)``.

    ``spans`` carries the source ``height`` and ``width``; runs map to runs, so no pixel is expanded.
    """

    def target(source: Column, old: str, new: Column) -> Column:
        return F.ceil(source * new / F.col(old)).cast("long")

    return (
        spans.withColumn("_ty0", target(F.col("y"), "height", to_height))
        .withColumn("_ty1", target(F.col("y") + 1, "height", to_height))
        .withColumn("_tx0", target(F.col("x0"), "width", to_width))
        .withColumn("_tx1", target(F.col("x1"), "width", to_width))
        .filter("_ty1 > _ty0 AND _tx1 > _tx0")
        .withColumn("_ty", F.explode(F.sequence(F.col("_ty0"), F.col("_ty1") - 1)))
        .select(*keys, F.col("_ty").alias("y"), F.col("_tx0").alias("x0"), F.col("_tx1").alias("x1"))
    )


#: Lines to either side that the first sweep of a growth takes at once.
FIRST_REACH = 2


def sweeps(radius: int) -> list[int]:
    """How far each sweep shifts lines to reach ``radius``: the first takes all lines near by, each further one about triples
    the reach with two shifted copies, so their number grows with the logarithm of the radius."""
    steps = [min(radius, FIRST_REACH)]
    while sum(steps) < radius:
        steps.append(min(2 * sum(steps) + 1, radius - sum(steps)))
    return steps


def _shifted(spans: DataFrame, mask: Sequence[str], step: int) -> DataFrame:
    """Every line for itself and for the lines ``step`` above and below; a line beyond the image stands for the first or last."""
    y, last = F.col("y"), F.col("height") - 1
    none = F.array().cast("array<bigint>")
    one = lambda c: F.array(c.cast("long"))
    whole = lambda a, b: F.sequence(a.cast("long"), b.cast("long"))
    up = F.when(y == 0, whole(F.lit(0), F.least(F.lit(step), last))).when(y + step <= last, one(y + step)).otherwise(none)
    down = F.when(y == last, whole(F.greatest(F.lit(0), last - step), last)).when(y - step >= 0, one(y - step)).otherwise(none)
    return spans.select(*mask, F.explode(F.concat(up, one(y), down)).alias("y"), "x0", "x1")


def dilate(spans: DataFrame, radius: int, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Grow by a square of side ``2 * radius + 1``; pixels outside the image stay outside.

    ``spans`` carries ``height`` and ``width``.
    """
    mask = [*keys, "height", "width"]
    reach, *further = sweeps(radius)
    first = F.greatest(F.lit(0), F.col("y") - reach)
    last = F.least(F.col("height") - 1, F.col("y") + reach)
    grown = spans.select(
        *mask,
        F.explode(F.sequence(first, last)).alias("y"),
        F.greatest(F.lit(0), F.col("x0") - radius).alias("x0"),
        F.least(F.col("width"), F.col("x1") + radius).alias("x1"),
    )
    grown = joined_runs(grown, [*mask, "y"])
    for step in further:
        grown = joined_runs(_shifted(grown, mask, step), [*mask, "y"])
    return grown


def erode(spans: DataFrame, radius: int, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Shrink by a square of side ``2 * radius + 1``; pixels outside the image count as set.

    A run shrinks at both ends except at the image border. A line keeps what all image lines within ``radius``
    cover. ``spans`` must be canonical and carry ``height`` and ``width``.
    """
    mask = [*keys, "height", "width"]
    x0 = F.when(F.col("x0") <= 0, F.lit(0)).otherwise(F.col("x0") + radius)
    x1 = F.when(F.col("x1") >= F.col("width"), F.col("width")).otherwise(F.col("x1") - radius)
    reach, *further = sweeps(radius)
    first = F.greatest(F.lit(0), F.col("y") - reach)
    last = F.least(F.col("height") - 1, F.col("y") + reach)
    shrunk = spans.select(
        *mask, F.explode(F.sequence(first, last)).alias("y"), x0.cast("long").alias("x0"), x1.cast("long").alias("x1")
    )
    shrunk = covered_runs(shrunk, [*mask, "y"], last - first + 1)
    for step in further:
        shrunk = covered_runs(_shifted(shrunk, mask, step), [*mask, "y"], F.lit(3))
    return shrunk


def close_open(
    spans: DataFrame, frames: DataFrame, close: int = 2, open_: int = 1, keys: Sequence[str] = MASK_KEYS
) -> DataFrame:
    """Fill small holes, then remove small specks: close with radius ``close``, open with radius ``open_``.

    A canonical mask is bounded by its image, so each is kept in one partition and the four sweeps follow without
    another shuffle.
    """
    key = list(keys)
    steps = union_runs(spans, key).join(not_broadcast(frames.select(*key, "height", "width")), key)
    for operation, radius in ((dilate, close), (erode, close), (erode, open_), (dilate, open_)):
        steps = operation(steps, radius, key)
    return steps.select(*key, "y", "x0", "x1")


def sample_points(
    spans: DataFrame, frames: DataFrame, num_points: int = 5, keys: Sequence[str] = MASK_KEYS
) -> DataFrame:
    """Evenly spaced foreground pixels in reading order; all of them if few, the image centre if none.

    Ranks are truncated, not rounded. The running length goes line by line and run by run, over at most the runs of
    one image.
    """
    key = list(keys)
    mask = Window.partitionBy(*key)
    before = mask.orderBy("y", "x0").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("x1") - F.col("x0")
    ranked = (
        spans.select(*key, "y", "x0", "x1")
        .withColumn("_total", F.sum(length).over(mask))
        .withColumn("_before", F.coalesce(F.sum(length).over(before), F.lit(0)))
    )
    last = F.lit(num_points - 1).cast("long")
    step = (F.col("_total") - 1).cast("double") / max(num_points - 1, 1)
    spaced = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda j: F.when((j == last) & (last > 0), F.col("_total") - 1).otherwise(F.floor(j * step)),
    )
    few = F.col("_total") <= num_points
    ranks = F.when(few, F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)).otherwise(spaced)
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + length))
    centre = F.col("y").isNull()
    chosen = frames.select(*key, "height", "width").join(not_broadcast(ranked), key, "full")
    ranks = F.when(centre, F.array(F.lit(0).cast("long"))).otherwise(here)
    return chosen.withColumn("_rank", F.explode(ranks)).select(
        *key,
        F.col("_rank").alias("point"),
        F.when(centre, F.floor(F.col("width") / 2)).otherwise(F.col("x0") + F.col("_rank") - F.col("_before")).cast("long").alias("x"),
        F.when(centre, F.floor(F.col("height") / 2)).otherwise(F.col("y")).cast("long").alias("y"),
    )
