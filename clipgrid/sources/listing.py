"""Listings made by the tasks: the driver neither holds nor sees a file name."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clipgrid.session import shared_folder

LISTED = "root_rank int, path string, length long, is_folder boolean"
#: Names below which nothing is listed, and which are no files of the user: those of Spark's own writers.
HIDDEN = ("_", ".")


def _entries(folder: str, patterns: Sequence[str]) -> Iterator[tuple[str, int, bool]]:
    """path, length and whether it is a folder, for what is directly in a folder; a missing one is empty."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    lead = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
    for info in store.get_file_info(fs.FileSelector(name, allow_not_found=True, recursive=False)):
        is_folder = info.type == fs.FileType.Directory
        if info.base_name.startswith(HIDDEN):
            continue
        if is_folder or not patterns or any(fnmatchcase(info.base_name, p) for p in patterns):
            yield lead + info.path, info.size or 0, is_folder


def walk_files(spark: SparkSession, roots: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """path, length and root_rank of the files below the roots, empty ones included; names beginning with _ or . are left out.

    Folders are listed level by level, each level by as many tasks as it has folders to share out, and every level is written,
    so a lost task lists its own folders again. ``patterns`` (``*.png``, ``metadata.json``) drop names where they are listed. All
    stores that pyarrow knows can be listed. Plain paths come without a scheme, as in ``list_files``.
    """
    kept = list(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in LISTED.split(", ")]
        for batch in batches:
            for rank, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for entry in _entries(folder, kept):
                    rows.append((rank, *entry))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    folder = shared_folder(spark, "listing")
    plain = [re.sub("^file:/+", "/", r) for r in roots]
    level = spark.createDataFrame([(i, r.rstrip("/") or "/") for i, r in enumerate(plain)], "root_rank int, path string")
    depth = 0
    while True:
        found = level.repartition("path").mapInArrow(run, LISTED)
        found.write.parquet(f"{folder}/level={depth}")
        listed = spark.read.schema(LISTED).parquet(f"{folder}/level={depth}")
        level = listed.filter("is_folder").select("root_rank", "path")
        if level.isEmpty():
            break
        depth += 1
    everything = spark.read.schema(LISTED).option("recursiveFileLookup", "true").parquet(folder)
    return everything.filter("NOT is_folder").select("path", "length", "root_rank")
