"""Process what is new since the last run, with or without a memory of earlier runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from clipgrid.sources.records import latest_rows


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    fmt: str = "json",
    max_files: int | None = None,
    **options: str,
) -> int:
    """Run a batch job over all files that arrived since the last call, and return the number of batches.

    The stream's checkpoint replaces per-row checks for finished work. Each batch writes a folder named after its
    number and replaces it when a failed batch runs again, so results appear exactly once. ``output`` and
    ``checkpoint`` must lie on shared storage.
    """
    batches: list[int] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    arrived = _arrived(spark, source, schema, fmt, max_files, options)
    _drain(arrived.writeStream.foreachBatch(handle), checkpoint)
    return len(batches)


def run_stateful(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    summarise: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    fmt: str = "json",
    max_files: int | None = None,
    **options: str,
) -> list[int]:
    """Carry aggregates over all files that ever arrived, and return the numbers of the batches of this call.

    ``summarise`` groups and aggregates. Its partial results live in the state store below ``checkpoint``, so a batch reads
    new files only, and each batch writes the new totals of the groups that it changed to a folder named after its number.
    The state of a batch is kept with its number: one that runs again starts from the batch before, replaces its folder by
    equal rows and counts nothing twice. :func:`current_rows` reads the totals. The number of state partitions is that of
    the first run; states beyond the executors' memory need the session's RocksDB provider.
    """
    batches: list[int] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    arrived = _arrived(spark, source, schema, fmt, max_files, options)
    _drain(summarise(arrived).writeStream.outputMode("update").foreachBatch(handle), checkpoint)
    return batches


def current_rows(spark: SparkSession, output: str, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """The totals of every group after the last batch, or after the batch ``upto``."""
    rows = spark.read.parquet(output)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    return latest_rows(rows, keys, run="batch")


def _arrived(
    spark: SparkSession, source: str, schema: T.StructType, fmt: str, max_files: int | None, options: dict[str, str]
) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(source)


def _drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
