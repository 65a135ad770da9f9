"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to unit length, turned by a seeded random rotation and cut into groups of ``DIMS`` coordinates. Every
curve takes one group, shifts it by a seeded offset, and orders all vectors by their position on a Hilbert curve through
that projection. Spark deals each order out by range, and ranks follow from sorted partitions. A vector whose rank is near
that of a query in any order is a candidate: queries are sent to the blocks of ranks that their window touches, and
each block hands on its nearest by exact cosine.

*Size.* Equal vectors are one row that keeps only as many of the smallest ids as can ever be returned, so any number of
copies costs nothing. Blocks hold ranks, not keys, and at most ``BLOCK`` of them, however the keys cluster and however
large the table is: more rows make more blocks, and a query goes to every block that its window touches. A task holds one
block at a time; its queries pass by in batches. A window is the larger of ``LEAST`` ranks and a share of all ranks; see the
README for the recall that goes with it.

Vectors that are null, empty, zero, or hold a null or non-finite component, or whose vec_id is null, take no part. Vectors
of another length than most take no part in distances to those: they are searched among their own kind. Repeated rows
with the same id and vector are one candidate; the same id on different vectors is a candidate by its nearest. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgrid.llm.common import starts_of
from clipgrid.llm.ranks import global_rank
from clipgrid.session import cut_lineage

DIMS, BITS, CURVES, SHARE, LEAST, SEED, NEAREST, EVERY = 8, 7, 32, 0.015, 256, 11, 5, 50
#: Ranks that one block holds at most.
BLOCK = 4096
#: Cosines of a matrix product that differ by less may stand in the other order when they are computed exactly.
NEARLY = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (unsigned, below ``2**bits``) on the Hilbert curve; at most 63 bits in all."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:  # undo the turns of the curve, from the coarsest level on
        low = q - one
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where(x[n - 1] & q != 0, flip ^ (q - one), flip).astype(np.uint64)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """One column per curve: the keys of the rows, which only their own components decide."""
    width = vectors.shape[1]
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(seed)
    keys = np.empty((len(unit), curves), np.int64)
    used, turned = width, unit
    dims = min(dims, width)
    for c in range(curves):
        if used + dims > width:  # every coordinate of a rotation serves once
            turned, used = unit @ np.linalg.qr(rng.standard_normal((width, width)))[0], 0
        part = turned[:, used : used + dims] * np.sqrt(width)  # about normal
        used += dims
        shift = rng.random(dims)
        cells = np.clip((part / 8.0 + 0.25 + shift / 2.0) * (1 << bits), 0, (1 << bits) - 1)
        keys[:, c] = hilbert(cells.astype(np.uint64), bits)
    return keys


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; does not depend on which rows are computed together."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id long and v array<double> of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def classes_of(rows: DataFrame, ids: int) -> DataFrame:
    """One row per distinct vector: v, the smallest ids, and the smallest as cid. Spark limits the ids before it shuffles."""
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))  # repeated rows do not use up the ids
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= ids)
    found = few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return found.withColumn("cid", F.get("ids", F.lit(0)))


def placed_on_curves(classes: DataFrame, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """cid, curve (by length of the vectors) and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = lists.take(pa.array(rows)).flatten().to_numpy().reshape(-1, size)
                for at in range(0, len(rows), 4096):
                    keys = curve_keys(part[at : at + 4096], curves, dims, bits, seed)
                    ends = pa.array(np.arange(len(keys) + 1) * curves, pa.int32())
                    cells = [pa.array(cids[rows[at : at + 4096]]), pa.array(np.full(len(keys), size), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
                    yield pa.RecordBatch.from_arrays(cells, ["cid", "size", "keys"])

    keyed = classes.select("cid", "v").mapInArrow(run, "cid long, size long, keys array<long>")
    return keyed.select("cid", "size", F.posexplode("keys").alias("c", "key")).select("cid", (F.col("size") * curves + F.col("c")).alias("curve"), "key")


def search(
    classes: DataFrame,
    asked: DataFrame,
    nearest: int,
    curves: int = CURVES,
    share: float = SHARE,
    least: int = LEAST,
    dims: int = DIMS,
    bits: int = BITS,
    seed: int = SEED,
    most: int = BLOCK,
) -> DataFrame:
    """q, cid, score: the ``nearest`` classes that the windows of each class in ``asked`` (cid) hold, itself included."""
    placed = cut_lineage(placed_on_curves(classes, curves, dims, bits, seed))
    ranked = global_rank(placed, F.col("curve"), F.col("key"), F.col("cid"))
    bounds = ranked.groupBy("curve").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(bounds, "curve").withColumn("rank", F.col("rank") - F.col("_first"))
    window = F.greatest(F.lit(least), F.ceil(F.col("_n") * share))
    ranked = ranked.withColumn("window", window).withColumn("block", F.least(F.lit(most), 2 * F.col("window") + 1))
    ranked = cut_lineage(ranked.join(classes.select("cid", "v"), "cid").select("cid", "v", "curve", "rank", "window", "block", F.col("_n").alias("n")))
    block = lambda r: F.floor(r / F.col("block"))
    own = ranked.select("cid", "v", "curve", "rank", "window", block(F.col("rank")).alias("at"), F.lit(False).alias("asks"))
    last = F.least(F.col("rank") + F.col("window"), F.col("n") - 1)
    reach = F.sequence(block(F.greatest(F.col("rank") - F.col("window"), F.lit(0))), block(last))
    queries = ranked.join(asked, "cid", "left_semi")
    queries = queries.select("cid", "v", "curve", "rank", "window", F.explode(reach).alias("at"), F.lit(True).alias("asks"))
    dealt = own.unionByName(queries).withColumn("task", F.shiftleft(F.col("curve"), 32) + F.col("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _nearest_by_task(batches, nearest):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["q", "cid", "score"])

    sorted_tasks = dealt.repartition("task").sortWithinPartitions("task", "asks")  # the rows of a block before its queries
    near = sorted_tasks.mapInArrow(run, "q long, cid long, score double")
    best = near.groupBy("q", "cid").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return best.withColumn("_rank", order).where(F.col("_rank") <= nearest).drop("_rank")


def _nearest_by_task(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passes the queries of each task by its block, which is held, in sorted batches where the block comes first."""
    current, held, block = None, [], None
    for batch in batches:
        task, asks, cid, rank, window = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("task", "asks", "cid", "rank", "window"))
        lists = batch.column(batch.schema.get_field_index("v"))
        begins = np.flatnonzero(starts_of(task, asks.astype(bool)))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(task)], strict=True):
            v = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            if task[a] != current:
                current, held, block = task[a], [], None
            if not asks[a]:
                held.append((v, cid[a:b], rank[a:b]))
                continue
            if block is None and held:
                block, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
            if block is not None:
                yield from _nearest_in_block(v, cid[a:b], rank[a:b], *block, int(window[a]), nearest)


def _nearest_in_block(v, cid, rank, offered, ids, ranks, window, nearest):
    """The nearest candidates of each query among the rows of a block within the window, by exact cosine and then by id."""
    scale = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    others = scale(offered)
    take = min(nearest, len(ids))
    for at in range(0, len(cid), 256):
        part = slice(at, at + 256)
        close = scale(v[part]) @ others.T
        close[np.abs(rank[part][:, None] - ranks[None, :]) > window] = -np.inf
        least = np.partition(close, len(ids) - take, axis=1)[:, len(ids) - take]
        picked = (close >= least[:, None] - NEARLY) & (close > -np.inf)  # these cosines are rounded in another way
        found = []
        for i in range(len(close)):
            j, many = np.flatnonzero(picked[i]), take
            while True:
                score = cosine(v[at + i][None, :], offered[j])
                order = np.lexsort((ids[j], -score))
                once = np.sort(np.unique(ids[j[order]], return_index=True)[1])[:nearest]  # the best row of each id
                if len(once) == nearest or many == len(ids):
                    break
                many = min(4 * many, len(ids))
                j = np.flatnonzero((close[i] >= np.partition(close[i], len(ids) - many)[len(ids) - many] - NEARLY) & (close[i] > -np.inf))
            first = order[once]
            if len(first):
                found.append((np.full(len(first), cid[at + i]), ids[j[first]], score[first]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, vector: str = "embedding", **options: float) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its nearest other rows."""
    rows = usable(vectors, vector)
    classes = cut_lineage(classes_of(rows, nearest + 1))
    asking = rows.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    asking = cut_lineage(asking.join(classes.select("v", "cid"), "v").select("query_id", F.col("cid").alias("q")))
    found = search(classes, asking.select(F.col("q").alias("cid")).distinct(), nearest + 1, **options)
    each = found.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    pairs = asking.join(each, "q").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = pairs.withColumn("rank", order).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
