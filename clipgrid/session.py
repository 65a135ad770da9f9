"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "clipgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; any of them can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not (master or "").startswith("local"):
        # A cluster starts from many partitions; the adaptive execution joins those below the advisory size.
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "2000"
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "128m"
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and executors share
    one disk, may fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` to a folder and read it back."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    A lost executor then costs no recomputation of the past. A written table is computed once, where a checkpoint
    would run its job twice, and later reads can prune its columns.
    """
    return settled(df, shared_folder(df.sparkSession, "cut"))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that a finished step has written, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
