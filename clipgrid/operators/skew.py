"""Building blocks that keep one hot clip from landing in one task.

A clip may own a large share of all rows, so nothing here windows or collects a whole clip. Per-clip figures are
map-side aggregates that are joined back over a salted key; positions within a clip come from bounded segments plus
a running total over the segment sizes; counted ranges are unfolded in blocks that are spread before they grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Salts of a session that does not set ``spark.clipgrid.salts``.
SALTS = 16
BLOCK = 32768
#: Integers that a row may unfold into where it lies, where a caller allows it.
NEAR = 1024


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows over the cores when the input has fewer partitions than there are cores.

    For costly work right behind a scan of few files; a scan of many files is left as it is. Not for plans with a
    shuffle, which would run to count their partitions.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def not_broadcast(rows: DataFrame) -> DataFrame:
    """Mark a join side that must be shuffled.

    The planner's size estimate ignores how many rows an ``explode`` makes, so it could broadcast unfolded frames or
    runs that are far larger than it believes.
    """
    return rows.hint("merge")


def session_salts(rows: DataFrame) -> int:
    """Ways to split a hot key: about as many as the tasks that should share it, a setting of the session."""
    return int(rows.sparkSession.conf.get("spark.clipgrid.salts", str(SALTS)))


def hash_salt(spread: Sequence[str | Column], salts: int = SALTS) -> Column:
    """A salt computed from row content: a re-run task assigns the same salt again."""
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def join_by_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join many rows per key with the few rows of that key in ``groups``.

    ``groups`` is repeated once per salt and the rows of a key are dealt over the salts. The copies come from a product, whose
    size the planner multiplies, where an ``explode`` would be planned as if it made none and be broadcast far too large. When the
    copies are below the session's broadcast threshold the salt costs nothing; else a hot key is split ``salts`` ways, and further
    by the adaptive skew join. ``how`` must keep the left side. ``groups`` should hold whole rows per key, not unfolded ones. Where
    groups are about as many as rows, copies cost more than they save: :func:`join_by_key` has none.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    salts = session_salts(rows) if salts is None else salts
    if salts == 1:
        return rows.join(groups, list(keys), how)
    left = rows.withColumn("_salt", hash_salt(spread, salts))
    copies = rows.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt"))
    right = groups.crossJoin(F.broadcast(copies))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_by_key(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with the rows of their key where a key is bounded, such as one frame or one mask, and keys are many.

    Neither side is copied or broadcast, whatever the planner takes its size to be; the adaptive skew join splits a hot key.
    """
    return rows.join(not_broadcast(groups), list(keys), how)


def with_group_stats(
    rows: DataFrame,
    keys: Sequence[str],
    stats: Sequence[Column],
    spread: Sequence[str | Column],
    salts: int | None = None,
) -> DataFrame:
    """Add per-key aggregates to every row (what an unordered window would do) without gathering a key.

    ``salts=1`` is for keys of bounded size, such as the cells of one map.
    """
    # Every row has its group; as a left join only the groups can be broadcast, never the rows.
    return join_by_group(rows, rows.groupBy(*keys).agg(*stats), keys, spread, "left", salts)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    segment: Column,
    name: str,
    start: int = 1,
) -> DataFrame:
    """``row_number`` per key for keys of any size.

    ``segment`` must not decrease along ``order`` within a key. Rows are numbered inside (key, segment); the sizes
    of the earlier segments of the key, one small row each, give the offset. The window and the join share one
    partitioning, so the rows move once.
    """
    tagged = rows.withColumn("_segment", segment)
    cell = [*keys, "_segment"]
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*cell, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    local = tagged.withColumn("_local", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return (
        local.join(not_broadcast(offsets), cell)
        .withColumn(name, F.col("_offset") + F.col("_local") + F.lit(start - 1))
        .drop("_segment", "_offset", "_local")
    )


def unfold(rows: DataFrame, count: Column, name: str, keys: Sequence[str], block: int = BLOCK, near: int = 0) -> DataFrame:
    """One row per integer ``0 .. count-1``, named ``name``.

    Blocks of integers are dealt over the cluster first, so a clip with a huge count is unfolded by many tasks. The
    partition number is given explicitly: the block rows are tiny and would otherwise be coalesced before they grow.

    Blocks of at most ``near`` integers stay where they are and only larger ones move. ``rows`` is then gone through twice,
    which pays where most counts are small and its shuffles can be used again.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.withColumn("_count", count.cast("long")).filter("_count > 0")
    blocks = counted.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / block)))
    )
    first = F.col("_block") * block
    last = F.least(F.col("_count"), first + block) - 1
    far = last - first >= near
    dealt = (blocks.filter(far) if near else blocks).repartition(partitions, *keys, "_block")
    spread_out = blocks.filter(~far).unionByName(dealt) if near else dealt
    return spread_out.withColumn(name, F.explode(F.sequence(first, last))).drop("_count", "_block")
