"""Attention maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrid.catalog.base import DENSE_MAPS, Case, dense_maps, register, table
from clipgrid.operators import attention as A
from clipgrid.operators.sampling import normalise_by_group
from clipgrid.operators.spans import close_open

CASES: dict[str, Case] = {}


@register(
    CASES,
    """
    SELECT l_orderkey AS vid, l_suppkey % 2 AS layer, l_partkey % 5 AS pos, round(avg(l_extendedprice / 7919), 6) AS w
    FROM lineitem GROUP BY ALL
    """,
)
def mean_attention(spark, folder):
    """Heads are line numbers, query positions are parts."""
    weights = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("vid"),
        (F.col("l_suppkey") % 2).alias("layer"),
        (F.col("l_partkey") % 5).alias("pos"),
        F.col("l_linenumber").alias("head"),
        (F.col("l_extendedprice") / 7919).alias("w"),
    )
    return A.mean_attention(weights).withColumn("w", F.round("w", 6))


@register(
    CASES,
    f"""
    WITH {DENSE_MAPS}
    SELECT vid, pos, round(CASE WHEN high - low > 1e-8 THEN (w - low) / (high - low) ELSE 0 END, 6) AS scaled
    FROM (SELECT *, min(w) OVER (PARTITION BY vid) AS low, max(w) OVER (PARTITION BY vid) AS high FROM maps)
    """,
)
def map_normalise(spark, folder):
    rows = normalise_by_group(dense_maps(spark, folder), ["vid"], "w", "scaled", 0.0, ["pos"])
    return rows.select("vid", "pos", F.round("scaled", 6).alias("scaled"))


# Four layers per clip: the embeddings of a clip are averaged per layer, as heads would be.
_LAYERS = f"""
{DENSE_MAPS},
layers AS (SELECT 'c' || label AS vid, vec_id % 4 AS layer, y, x, avg(w) AS w FROM maps GROUP BY ALL),
found AS (SELECT vid, count(DISTINCT layer) AS layers FROM layers GROUP BY vid),
scaled AS (SELECT *, CASE WHEN high - low > 1e-8 THEN (w - low) / (high - low) ELSE 0 END AS s
  FROM (SELECT *, min(w) OVER (PARTITION BY vid, layer) AS low, max(w) OVER (PARTITION BY vid, layer) AS high
        FROM layers)),
fused AS (SELECT vid, y, x, CASE WHEN layers = 4 THEN sum(s * [0.1, 0.2, 0.3, 0.4][layer + 1]::DOUBLE) END AS w
  FROM scaled JOIN found USING (vid) GROUP BY vid, y, x, layers)"""


def _layers(spark, folder):
    """Some labels have vectors of fewer than four layers; those clips stay and come out without values."""
    return (
        dense_maps(spark, folder)
        .groupBy(F.concat(F.lit("c"), "label").alias("vid"), (F.col("vec_id") % 4).alias("layer"), "y", "x")
        .agg(F.avg("w").alias("w"))
    )


@register(CASES, f"WITH {_LAYERS} SELECT vid, y, x, round(w, 6) AS w FROM fused")
def attention_fuse(spark, folder):
    fused = A.fuse_layers(_layers(spark, folder), [0, 1, 2, 3], [1, 2, 3, 4], incomplete="null")
    return fused.withColumn("w", F.round("w", 6))


@register(
    CASES,
    f"""
    WITH {_LAYERS},
    norm AS (SELECT *, min(w) OVER (PARTITION BY vid) AS low, max(w) OVER (PARTITION BY vid) AS high FROM fused),
    kept AS (SELECT vid, y, x FROM norm WHERE CASE WHEN high - low > 1e-8 THEN (w - low) / (high - low) ELSE 0 END >= 0.4)
    SELECT vid, y, min(x) AS x0, max(x) + 1 AS x1
    FROM (SELECT *, x - row_number() OVER (PARTITION BY vid, y ORDER BY x) AS g FROM kept) GROUP BY vid, y, g
    UNION ALL SELECT vid, NULL, NULL, NULL FROM found WHERE layers < 4
    """,
)
def threshold_runs(spark, folder):
    """Clips without a fused map are rows without a run."""
    fused = A.fuse_layers(_layers(spark, folder), [0, 1, 2, 3], [1, 2, 3, 4], incomplete="null")
    none = fused.groupBy("vid").agg(F.count("w").alias("n")).filter("n = 0").select("vid")
    return A.threshold_runs(fused, 0.4).unionByName(none, allowMissingColumns=True)


_PREFIX = f"""
{DENSE_MAPS},
lifted AS (SELECT vid, vec_id, pos, w + CASE WHEN pos < vec_id % 70 THEN 5 ELSE 0 END AS v FROM maps),
lead AS (SELECT vid, count(*) AS n, min(CASE WHEN v <= mean THEN pos END) AS low FROM (
    SELECT *, avg(v) OVER (PARTITION BY vid) AS mean FROM lifted) GROUP BY vid),
counted AS (SELECT vid, CASE WHEN coalesce(low, n) < 9 THEN least(9, n) ELSE coalesce(low, n) END AS c FROM lead),
sized AS (SELECT vid, CAST(floor(sqrt(c)) AS BIGINT) AS side, CAST(floor(sqrt(c)) * floor(sqrt(c)) AS BIGINT) AS num_positions FROM counted)"""


def _lifted(spark, folder):
    lift = F.when(F.col("pos") < F.col("vec_id") % 70, 5).otherwise(0)
    return dense_maps(spark, folder).select("vid", "pos", (F.col("w") + lift).alias("w"))


@register(CASES, f"WITH {_PREFIX} SELECT vid, num_positions FROM sized")
def image_positions(spark, folder):
    return A.image_positions(_lifted(spark, folder), ["vid"], at_least=9)


@register(CASES, f"WITH {DENSE_MAPS} SELECT DISTINCT vid, 64 AS num_positions FROM maps")
def image_positions_default(spark, folder):
    """With the default of at least 256 positions a sequence of 64 counts as a whole."""
    return A.image_positions(_lifted(spark, folder), ["vid"])


@register(
    CASES,
    f"""
    WITH {DENSE_MAPS},
    counts AS (SELECT DISTINCT vid, vec_id, 1 + vec_id % 64 AS n, CAST(ceil(sqrt(1 + vec_id % 64)) AS BIGINT) AS side FROM maps),
    grid AS (SELECT vid, n, side, unnest(range(side * side)) AS pos FROM counts)
    SELECT c.vid, c.pos // side AS y, c.pos % side AS x, round(CASE WHEN c.pos < n THEN m.w ELSE 0 END, 6) AS w
    FROM grid c LEFT JOIN maps m ON c.vid = m.vid AND c.pos = m.pos
    """,
)
def attention_grid(spark, folder):
    maps = dense_maps(spark, folder)
    counts = table(spark, folder, "embeddings").select(
        F.concat(F.lit("e"), "vec_id").alias("vid"), (F.col("vec_id") % 64 + 1).alias("num_positions")
    )
    return A.to_grid(maps, counts, ["vid"]).withColumn("w", F.round("w", 6))


# Morphology as neighbourhood counts: a pixel grows from any set neighbour and survives if all neighbours in the image are set.
def _grow(source: str, name: str, radius: int) -> str:
    return f"""
{name} AS (SELECT DISTINCT vid, y + dy AS y, x + dx AS x FROM {source}, range(-{radius}, {radius} + 1) a(dy), range(-{radius}, {radius} + 1) b(dx)
  WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"""


def _shrink(source: str, name: str, radius: int) -> str:
    return f"""
{name} AS (
  SELECT vid, ty AS y, tx AS x FROM (
    SELECT vid, y + dy AS ty, x + dx AS tx FROM {source}, range(-{radius}, {radius} + 1) a(dy), range(-{radius}, {radius} + 1) b(dx))
  WHERE ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY vid, ty, tx
  HAVING count(*) = (least(7, ty + {radius}) - greatest(0, ty - {radius}) + 1) * (least(7, tx + {radius}) - greatest(0, tx - {radius}) + 1))"""


@register(
    CASES,
    f"""
    WITH {DENSE_MAPS},
    start AS (SELECT vid, y, x FROM maps WHERE w > 0.1), {_grow("start", "c1", 2)}, {_shrink("c1", "c2", 2)},
    {_shrink("c2", "o1", 1)}, {_grow("o1", "o2", 1)}
    SELECT vid, y, min(x) AS x0, max(x) + 1 AS x1
    FROM (SELECT *, x - row_number() OVER (PARTITION BY vid, y ORDER BY x) AS g FROM o2) GROUP BY vid, y, g
    """,
)
def mask_close_open(spark, folder):
    pixels = dense_maps(spark, folder).filter("w > 0.1")
    spans = pixels.select("vid", "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1"))
    frames = table(spark, folder, "embeddings").select(
        F.concat(F.lit("e"), "vec_id").alias("vid"),
        F.lit(8).cast("long").alias("height"),
        F.lit(8).cast("long").alias("width"),
    )
    return close_open(spans, frames, keys=["vid"])
