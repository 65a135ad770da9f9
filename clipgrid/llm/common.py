"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import clipgrid

# Functions of this package travel to the workers with the job, so it need not be installed there.
cloudpickle.register_pickle_by_value(clipgrid)

#: Bytes of ASCII white space that separate words everywhere in this package.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The cells of a string column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again in slices that hold about ``most`` bytes of ``column``; a longer cell is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def whole_groups(
    batches: Iterator[pa.RecordBatch], key: str | Callable[[pa.Table], np.ndarray], rows: int = 200_000, most: int = 32 << 20
) -> Iterator[pa.Table]:
    """Sorted batches of a partition as tables of about ``rows`` rows or ``most`` bytes that never cut through a key."""
    of = key if callable(key) else lambda t: t.column(key).to_numpy()
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
        if count < rows and size < most:
            continue
        whole = pa.Table.from_batches(held)
        values = of(whole)
        differ = values[::-1] != values[-1]
        last = len(values) - int(np.argmax(differ)) if differ.any() else 0
        if last:
            yield whole.slice(0, last)
            rest = whole.slice(last).combine_chunks()
            held, count, size = rest.to_batches(), rest.num_rows, rest.nbytes
        else:  # one value so far: wait for its end, and look again when there is twice as much
            rows, most = max(rows, 2 * count), max(most, 2 * size)
    if count:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows at which a run of equal rows begins."""
    n = len(columns[0])
    first = np.zeros(n, bool)
    if n:
        first[0] = True
        for column in columns:
            first[1:] |= column[1:] != column[:-1]
    return first
