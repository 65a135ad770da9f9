"""Tables that were written by many runs, reduced to what their readers take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrid.session import remove_folder, settled, shared_folder


def _stored(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:  # text formats do not say their types
        names = {f.name for f in schema.fields}
        more = [T.StructField(n, t) for n, t in (("run", T.LongType()), ("bucket", T.IntegerType())) if n not in names]
        reader = reader.schema(T.StructType([*schema.fields, *more]))
    return reader.load(path)


def changed_buckets(rows: DataFrame, keys: Sequence[str], many: bool = False) -> list[int]:
    """Buckets with a key of more than one run (or, unless ``many``, row); as many as a table has buckets at most."""
    age = F.coalesce("run", F.lit(-1))
    per_key = rows.groupBy("bucket", *keys).agg(F.min(age).alias("first"), F.max(age).alias("last"), F.count(F.lit(1)).alias("n"))
    again = per_key.filter("first < last" if many else "n > 1")
    return sorted(r.bucket for r in again.select("bucket").distinct().collect())


def compact(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    many: bool = False,
) -> list[int]:
    """Keep the row of the last run per key, with ``many`` all rows that the last run of a key wrote. Returns the buckets done.

    Only buckets with something to drop are written. Their rows are first settled in a folder of their own and then take
    the place of the old ones by a dynamic overwrite: Spark writes all new files aside and swaps the buckets when every task
    is done, so a compaction that fails leaves the old buckets, and readers see the same rows before and after. One writer at
    a time: a run that appends while its bucket is swapped would be lost.
    """
    rows = _stored(spark, path, fmt, schema)
    buckets = changed_buckets(rows, keys, many)
    if not buckets:
        return []
    picked = rows.filter(F.col("bucket").isin(buckets))
    age, key = F.coalesce("run", F.lit(-1)), list(keys)
    if many:
        last = picked.groupBy("bucket", *key).agg(F.max(age).alias("_last"))
        kept = picked.join(last, ["bucket", *key]).filter(age == F.col("_last")).select(*rows.columns)
    else:
        rest = [c for c in rows.columns if c not in ("bucket", *key)]
        last = picked.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), age).alias("_row"))
        kept = last.select(*key, "_row.*", "bucket").select(*rows.columns)
    folder = shared_folder(spark, "compact")
    swap_buckets(settled(kept, folder), path, keys, fmt)
    remove_folder(spark, folder)
    return buckets


def swap_buckets(rows: DataFrame, path: str, order: Sequence[str], fmt: str) -> None:
    """Replace the buckets of ``rows`` and leave all others as they are."""
    dealt = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.partitionBy("bucket").format(fmt).save(path)
