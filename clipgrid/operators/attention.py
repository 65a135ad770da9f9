"""Attention weights as rows: averaging, grids, fusion and thresholds.

A map or vector is bounded by the grid or sequence it comes from, so windows over a clip or layer gather no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgrid.operators.sampling import normalise_by_group
from clipgrid.operators.spans import pixels_to_runs

# Fewest image positions assumed in a sequence (a grid of 16 by 16).
MIN_IMAGE_POSITIONS = 256


def mean_attention(weights: DataFrame, keys: Sequence[str] = ("vid", "layer")) -> DataFrame:
    """Mean over heads and query positions for each key position ``pos``."""
    return weights.groupBy(*keys, "pos").agg(F.avg("w").alias("w"))


def image_positions(
    vectors: DataFrame, keys: Sequence[str] = ("vid", "layer"), at_least: int = MIN_IMAGE_POSITIONS
) -> DataFrame:
    """How many leading positions belong to the image.

    The leading run of weights above the mean, at least ``at_least`` (or all there are), cut to a square number.
    """
    whole = Window.partitionBy(*keys)
    low = F.when(F.col("w") <= F.col("_mean"), F.col("pos"))
    run = (
        vectors.withColumns({"_n": F.count(F.lit(1)).over(whole), "_mean": F.avg("w").over(whole)})
        .groupBy(*keys)
        .agg(F.min(low).alias("_low"), F.max("_n").alias("_n"))
    )
    lead = F.coalesce(F.col("_low"), F.col("_n"))
    count = F.when(lead < at_least, F.least(F.lit(at_least), F.col("_n"))).otherwise(lead)
    side = F.floor(F.sqrt(count)).cast("long")
    return run.select(*keys, (side * side).alias("num_positions"))


def grid_side(count: Column) -> Column:
    """Side of the smallest square grid that holds ``count`` cells."""
    return F.ceil(F.sqrt(count)).cast("long")


def to_grid(vectors: DataFrame, counts: DataFrame, keys: Sequence[str] = ("vid", "layer")) -> DataFrame:
    """Lay the leading positions out row by row on a square grid; cells beyond the count are 0."""
    side = grid_side(F.col("num_positions"))
    given = vectors.select(*keys, "pos", "w").join(counts, list(keys)).filter("pos < num_positions")
    padding = (
        counts.withColumn("_cells", side * side)
        .filter("_cells > num_positions")
        .withColumn("pos", F.explode(F.sequence(F.col("num_positions"), F.col("_cells") - 1)))
        .select(*keys, "pos", F.lit(0.0).alias("w"), "num_positions")
    )
    cells = given.select(*keys, "pos", "w", "num_positions").unionByName(padding)
    return cells.select(
        *keys, F.floor(F.col("pos") / side).alias("y"), (F.col("pos") % side).alias("x"), "w"
    )


def fuse_layers(
    maps: DataFrame,
    layers: Sequence[int],
    weights: Sequence[float],
    keys: Sequence[str] = ("vid",),
    incomplete: str = "fail",
) -> DataFrame:
    """Weighted sum of the min-max scaled maps of all layers, weights scaled to sum 1.

    Fails when a clip does not have exactly the given layers; with ``incomplete="null"`` its cells are null instead. The
    weights are configuration and travel as a literal.
    """
    if incomplete not in ("fail", "null"):
        raise ValueError(f"unknown treatment {incomplete!r} of incomplete clips")
    if not 0 < len(layers) == len(weights):
        raise ValueError(f"{len(weights)} weights for {len(layers)} layers")
    total = float(sum(weights))
    table = F.create_map(*[F.lit(v) for layer, w in zip(layers, weights) for v in (int(layer), float(w) / total)])
    weight = F.try_element_at(table, F.col("layer").cast("int"))
    key = list(keys)
    clip, layer = Window.partitionBy(*key), Window.partitionBy(*key, "layer")
    found = F.size(F.collect_set(F.coalesce(F.col("layer").cast("int"), F.lit(-1))).over(clip))
    wrong = (found != len(layers)) | F.bool_or(weight.isNull()).over(clip)
    # All that follows stays in the partitions of the clips.
    rows = maps.repartition(*key).withColumns(
        {"_low": F.min("w").over(layer), "_high": F.max("w").over(layer), "_wrong": wrong, "_weight": weight}
    )
    failure = F.raise_error(F.lit("layers of a clip do not match the weights")) if incomplete == "fail" else F.lit(None).cast("double")
    checked = F.when(F.col("_wrong"), failure).otherwise(F.col("_weight"))
    extent = F.col("_high") - F.col("_low")
    scaled = F.when(extent > 1e-8, (F.col("w") - F.col("_low")) / extent).otherwise(F.lit(0.0))
    return rows.groupBy(*key, "y", "x").agg(F.sum(checked * scaled).alias("w"))


def threshold_runs(maps: DataFrame, threshold: float, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Mask of the cells whose scaled value reaches the threshold, as runs."""
    scaled = normalise_by_group(maps, keys, "w", "_scaled", 0.0, ["y", "x"], salts=1)
    return pixels_to_runs(scaled.filter(F.col("_scaled") >= threshold), keys)
