"""Large JSON arrays and maps, read by many tasks.

A file is read in the byte ranges that Spark deals out, in pieces that end at ``}``, which any file system of Spark can do. What a
bracket, comma or quote means depends on all text before it, so two passes are made:

1. Every range tells what it does for either start, outside or inside a string: whether quotes turn the state, how the depth
   changes, and how many separators it has at each depth relative to its start. A scan over the ranges of a file in order, one
   small row each, composes these into the state, depth and element number at which each range starts.
2. With that, every range cuts its elements at depth one. The parts of elements that cross ranges are joined by their number.

An escaped quote never begins a range: a piece begins behind a ``}``, and no escape sequence ends with one. Ranges are matched by
a broadcast of one row per range, so its size is that of the input divided by the size of a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrid.session import cut_lineage

QUOTE, SLASH, COMMA = (ord(c) for c in '"\\,')
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[COMMA] = True


def marks(data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of quotes, places of brackets and commas, and how many quotes stand before each; escaped quotes do not count."""
    quotes = np.flatnonzero(data == QUOTE)
    slash = data == SLASH
    if len(quotes) and slash.any():
        place = np.arange(len(data))
        other = np.maximum.accumulate(np.where(slash, -1, place))  # the last character that is no backslash
        before = np.maximum(quotes - 1, 0)
        run = np.where(quotes > 0, before - other[before], 0)
        quotes = quotes[run % 2 == 0]
    places = np.flatnonzero(_MARK[data])
    return len(quotes), places, np.searchsorted(quotes, places)


def depths(data: np.ndarray, places: np.ndarray, before: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places outside strings, the step that each makes, and the depth after it."""
    outside = places[(before + inside) % 2 == 0]
    step = _STEP[data[outside]]
    return outside, step, depth + np.cumsum(step)


class _Range:
    """What a range does for either start."""

    def __init__(self) -> None:
        self.turns = 0
        self.delta = [0, 0]
        self.found: list[dict[int, int]] = [{}, {}]  # separators by depth relative to the start

    def add(self, data: np.ndarray) -> None:
        quotes, places, before = marks(data)
        for start in (0, 1):
            _, step, depth = depths(data, places, before, (start + self.turns) % 2 == 1, self.delta[start])
            if len(depth):
                # A bracket that closes depth one ends an element as a comma at depth one does.
                ends = np.concatenate([depth[step == 0], depth[step < 0] + 1])
                for d, n in zip(*np.unique(ends, return_counts=True), strict=True):
                    self.found[start][int(d)] = self.found[start].get(int(d), 0) + int(n)
                self.delta[start] = int(depth[-1])
        self.turns += quotes

    def after(self, inside: bool, depth: int, number: int) -> tuple[bool, int, int]:
        """State, depth and element number behind the range."""
        number += self.found[inside].get(1 - depth, 0)
        return bool((inside + self.turns) % 2), depth + self.delta[inside], number


def cut(data: bytes, inside: bool, depth: int) -> tuple[list[tuple[str, int, int]], bool, int]:
    """The texts between brackets and commas of depth one as (what ends it, begin, end), and the state behind ``data``."""
    raw = np.frombuffer(data, np.uint8)
    quotes, places, before = marks(raw)
    outside, step, after = depths(raw, places, before, inside, depth)
    ends = (step == 0) & (after == 1) | (step < 0) & (after == 0) | (step > 0) & (after == 1)
    found, begin = [], 0 if depth > 0 else None
    for place, s in zip(outside[ends].tolist(), step[ends].tolist(), strict=True):
        if s <= 0 and begin is not None:
            found.append(("close" if s else "comma", begin, place))
        begin = None if s < 0 else place + 1
    last = int(after[-1]) if len(after) else depth
    if begin is not None:
        found.append(("", begin, len(data)))
    return found, bool((inside + quotes) % 2), last


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bytes]]:
    """The text of every run of rows of one range, and its first row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).cast(pa.binary()).to_pylist()
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (files[i], blocks[i]) != (files[begin], blocks[begin]):
                yield files[begin], blocks[begin], batch.slice(begin, 1), b"}".join(values[begin:i]) + b"}"
                begin = i


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _range_starts(pieces: DataFrame) -> DataFrame:
    """file, block, inside, depth and number at the start of every range."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, _Range()
        for file, block, _, text in _runs(batches):
            if key is not None and key != (file, block):
                yield _told(key, held)
                held = _Range()
            key = (file, block)
            held.add(np.frombuffer(text, np.uint8))
        if key is not None:
            yield _told(key, held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (False, 0, 0)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != now:
                    now, state = r["file"], (False, 0, 0)
                out.append((r["file"], r["block"], *state))
                held = _Range()
                held.turns, held.delta = r["turns"], [r["delta"]["a"], r["delta"]["b"]]
                held.found = [{e["d"]: e["n"] for e in r["found"][k]} for k in ("a", "b")]
                state = held.after(*state)
            if out:
                types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                cells = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cells, ["file", "block", "inside", "depth", "number"])

    ends = "array<struct<d:long,n:long>>"
    told = pieces.mapInArrow(tell, f"file string, block long, turns long, delta struct<a:long,b:long>, found struct<a:{ends},b:{ends}>")
    ordered = told.repartition("file").sortWithinPartitions("file", "block")
    return ordered.mapInArrow(scan, "file string, block long, inside boolean, depth long, number long")


def _told(key: tuple[str, int], held: _Range) -> pa.RecordBatch:
    ends = pa.list_(pa.struct([("d", pa.int64()), ("n", pa.int64())]))
    found = {k: [{"d": d, "n": n} for d, n in held.found[i].items()] for i, k in enumerate("ab")}
    cells = [
        pa.array([key[0]]),
        pa.array([key[1]], pa.int64()),
        pa.array([held.turns], pa.int64()),
        pa.array([{"a": held.delta[0], "b": held.delta[1]}], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
        pa.array([found], pa.struct([("a", ends), ("b", ends)])),
    ]
    return pa.RecordBatch.from_arrays(cells, ["file", "block", "turns", "delta", "found"])


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, number and text of every element of the JSON arrays at ``path``, or of every ``"key": value`` of JSON maps.

    ``number`` counts from 0 in each file. Blank elements, as of an empty array, are left out. The elements are written once, as
    their parts are read for two ends and most users read rows of annotations more than once.
    """
    pieces = _pieces(spark, path)
    starts = _range_starts(pieces)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, parts, crossed = None, (False, 0), [], False
        number = 0
        for file, block, row, text in _runs(batches):
            out: list[tuple] = []
            if key != (file, block):
                if key is not None and parts:
                    out.append((*key, number, False, b"".join(parts)))
                key, parts = (file, block), []
                inside, depth, number = (row.column(c)[0].as_py() for c in (3, 4, 5))
                state, crossed = (inside, depth), depth > 0
            found, *state = cut(text, *state)
            for end, a, b in found:
                parts.append(text[a:b])
                if end:
                    out.append((file, block, number, not crossed, b"".join(parts)))
                    parts, crossed, number = [], False, number + 1
            if out:
                yield _element_rows(out)
        if key is not None and parts:
            yield _element_rows([(*key, number, False, b"".join(parts))])

    here = pieces.join(F.broadcast(starts), ["file", "block"])
    kinds = "file string, block long, number long, whole boolean, text string"
    found = cut_lineage(here.select("file", "block", "value", "inside", "depth", "number").mapInArrow(elements, kinds))
    piece = F.struct("block", "text")
    crossing = found.filter("NOT whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    joined = crossing.select("file", "number", F.array_join(F.col("p.text"), "").alias("text"))
    rows = found.filter("whole").select("file", "number", "text").unionByName(joined)
    return rows.filter(~F.col("text").rlike(r"^\s*$"))


def _element_rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    cells = [pa.array(c, pa.binary()).cast(t) if i == 4 else pa.array(c, t) for i, (c, t) in enumerate(zip(zip(*out, strict=True), types, strict=True))]
    return pa.RecordBatch.from_arrays(cells, ["file", "block", "number", "whole", "text"])
