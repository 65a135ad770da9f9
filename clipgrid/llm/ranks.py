"""Positions in a total order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.session import cut_lineage


def global_rank(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the order.

    Rows are dealt out by range and sorted in their partitions. Then one count per partition, of which there are as many
    as partitions, tells how many rows stand before each. The sorted rows are written first, so a lost task cannot
    deal them anew. Rows that are equal in ``order`` take any turn.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns(keys)
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.max(row) + 1).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    starts = F.array(*(F.lit(b).cast("long") for b in before)) if before else F.array(F.lit(0).cast("long"))
    return placed.withColumn(name, F.element_at(starts, (part + 1).cast("int")) + row).drop("_at")
