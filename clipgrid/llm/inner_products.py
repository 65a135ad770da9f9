"""Exact search for the largest integer inner products, by descending length with pruned partial sums.

Vectors are rows of integers, ``floor(SCALE * x)``. No inner product exceeds the product of the lengths, so vectors are taken by
descending length, in segments of ``SEGMENT`` ranks. The first wave is the first segment, and each further one takes one segment
more than all before it; between waves the ``nearest + 1``-th score of every query becomes its threshold, so that a wave hands
on few rows per query, whatever its size.

In a task a block of queries meets one segment. Both are turned by the right singular vectors of all vectors, scaled to unit length
(eigenvectors of their Gram matrix), which puts most of every length into the first coordinates. The partial sum over the first ones plus the product
of the lengths of the rest bounds the inner product (Cauchy-Schwarz); what stays below the threshold is dropped, over ``CUTS`` of
the coordinates one after another. The bounds are floating and get a margin; scores are computed from the integers and are exact.

*Size.* Equal vectors are one class that keeps the ``nearest + 1`` smallest ids, which are all that can ever be returned, so copies
cost nothing. A task holds ``QUERIES`` queries and passes a segment by in slices of ``SLICE`` rows. A row goes to the blocks of
queries that its length allows, once for each. The work is queries times rows where no bound holds. To the driver come one square
matrix of the dimension, and counts per partition.

*Odd input.* Null vectors and vectors with a null or non-finite component take no part, nor do rows with a null vec_id or a
component that is 2**500 or larger when scaled. Zero and empty vectors do. Vectors of different sizes have no inner product; each
is searched among its own kind, and those of the most frequent size are turned. Rows of equal id and vector are one row; rows of
one id with different vectors are different candidates, and each is asked. Scores beyond 64 bits are cut to 2**63 - 1 or its
negative. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgrid.llm.common import starts_of
from clipgrid.llm.curves import classes_of
from clipgrid.llm.ranks import global_rank
from clipgrid.operators.skew import join_by_group
from clipgrid.session import cut_lineage

SCALE, NEAREST, EVERY = 1024, 10, 100
SEGMENT, QUERIES, SLICE = 8192, 8192, 512
#: Shares of the coordinates after which candidates are dropped.
CUTS = (0.5, 0.75)
#: Share of survivors of a slice below which they are scored one by one, not by a matrix product.
FEW = 0.03
#: Whole numbers below EXACT are exact as doubles.
EXACT, HUGE, LONG = 2.0**53, 2.0**500, (1 << 63) - 1


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id long and v array<double> of whole numbers, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale >= HUGE)))
    # A double times a power of two is exact. Adding 0.0 makes -0.0 equal to 0.0.
    whole = F.transform("v", lambda x: F.when(F.abs(x) >= EXACT, x * scale).otherwise(F.floor(x * scale).cast("double")) + 0.0)
    return rows.select("vec_id", whole.alias("v"))


def rotation(classes: DataFrame) -> tuple[int, np.ndarray] | None:
    """The most frequent size and the eigenvectors of the Gram matrix of all rows of that size, the largest first."""
    size = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None or not size["n"]:
        return None
    n = size["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(-1, n)
            norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            rows = np.divide(rows, norm, out=np.zeros_like(rows), where=(norm > 0) & np.isfinite(norm))
            total += rows.T @ rows
        at = pa.array(np.arange(n * n, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], ["at", "x"])

    sums = classes.where(F.size("v") == n).select("v").mapInArrow(run, "at long, x double")
    gram = np.zeros(n * n)
    for r in sums.groupBy("at").agg(F.sum("x").alias("x")).collect():
        gram[r["at"]] = r["x"]
    return n, np.linalg.eigh(gram.reshape(n, n))[1][:, ::-1].copy()


def by_length(rows: DataFrame) -> DataFrame:
    """Adds ``place``: the rank by descending length among the rows of equal size."""
    ranked = global_rank(rows, F.col("size"), -F.col("norm"), F.col("cls"))
    first = ranked.groupBy("size").agg(F.min("rank").alias("_first"))
    return join_by_group(ranked, first, ["size"], ["cls"]).withColumn("place", F.col("rank") - F.col("_first")).drop("rank", "_first")


class _Block:
    """A block of queries and what is best for each so far."""

    def __init__(self, q: np.ndarray, v: np.ndarray, least: np.ndarray, turn: np.ndarray | None, keep: int) -> None:
        self.q, self.v, self.least, self.turn, self.keep = q, v, least, turn, keep
        self.norm = _lengths(v)
        self.turned, self.rest = _partial(v, turn)
        none = np.empty(0, np.int64)
        self.found = (none, none, none, none)  # row of the query, score, smallest id and number of the class

    def meet(self, cid: np.ndarray, cls: np.ndarray, v: np.ndarray) -> None:
        """Takes candidates in order of descending length."""
        for at in range(0, len(cid), SLICE):
            part = slice(at, at + SLICE)
            self._slice(cid[part], cls[part], v[part])

    def _slice(self, cid: np.ndarray, cls: np.ndarray, v: np.ndarray) -> None:
        norm = _lengths(v)
        margin = 1e-9 * self.norm * norm.max() + 1e-6
        live = np.flatnonzero(self.norm * norm.max() + margin >= self.least)
        if not len(live):
            return
        turned, rest = _partial(v, self.turn)
        sums, before, passed = np.zeros((len(live), len(cid))), 0, np.ones((len(live), len(cid)), bool)
        for cut, tail in rest.items():
            sums += self.turned[live, before:cut] @ turned[:, before:cut].T
            passed = sums + self.rest[cut][live, None] * tail[None, :] >= (self.least - margin)[live, None]
            some = passed.any(axis=1)
            live, sums, passed, before = live[some], sums[some], passed[some], cut
        if not len(live):
            return
        i, j = np.nonzero(passed)
        score = self._scores(live, v, i, j)
        good = score >= (self.least - margin)[live[i]]
        self._keep(live[i[good]], score[good], cid[j[good]], cls[j[good]])

    def _scores(self, live: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own = self.v[live]
        bound = self.norm[live].max() * _lengths(v).max() * 1.001
        if not bound < EXACT:  # whole numbers of any size
            out = np.empty(len(i), np.int64)
            for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                exact = sum(int(x) * int(y) for x, y in zip(own[a], v[b], strict=True))
                out[k] = max(-LONG, min(LONG, exact))
            return out
        if len(i) > FEW * len(own) * len(v):
            return (own @ v.T)[i, j].astype(np.int64)
        parts = [(own[i[k : k + 65536]] * v[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]
        return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)

    def _keep(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        row, score, cid, cls = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((cls, cid, -score, row))
        row = row[order]
        begin = np.flatnonzero(starts_of(row))
        turn = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        last = turn == self.keep - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[order[last]].astype(float))
        order = order[turn < self.keep]
        self.found = (row[turn < self.keep], score[order], cid[order], cls[order])

    def rows(self) -> pa.RecordBatch:
        row, score, cid, cls = self.found
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.q[row], cls, cid, score)], ["q", "cls", "cid", "score"])


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _partial(v: np.ndarray, turn: np.ndarray | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Turned rows, and by number of leading coordinates the length of the rest."""
    turned = v if turn is None else v @ turn
    squares = turned * turned
    cuts = sorted({round(share * v.shape[1]) for share in CUTS} - {0})
    return turned, {c: np.sqrt(squares[:, c:].sum(axis=1)) for c in cuts}


TASK = ["size", "block", "segment"]


def _meet(batches: Iterator[pa.RecordBatch], turns: dict[int, np.ndarray], keep: int) -> Iterator[pa.RecordBatch]:
    """Passes the candidates of each task by its queries, which come first and are held."""
    current, block, held = None, None, []
    for batch in batches:
        column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        size, number, segment, cls, cid, least = (column(c).to_numpy() for c in (*TASK, "cls", "cid", "least"))
        asks = column("asks").to_numpy(zero_copy_only=False).astype(bool)
        begins = np.flatnonzero(starts_of(size, number, segment, asks))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(size)], strict=True):
            v = column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, int(size[a]))
            task = (size[a], number[a], segment[a])
            if task != current:
                if block is not None:
                    yield block.rows()
                current, block, held = task, None, []
            if asks[a]:
                held.append((cls[a:b], v, least[a:b]))
                continue
            if block is None and held:
                block = _Block(*(np.concatenate(x) for x in zip(*held, strict=True)), turns.get(int(size[a])), keep)
                held = []
            if block is not None:
                block.meet(cid[a:b], cls[a:b], v)
    if block is not None:
        yield block.rows()


def search(classes: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """q, cls, cid, score: for each class in ``asked`` (cls) the ``keep`` classes of the largest inner products, itself included."""
    turn = rotation(classes)
    turns = {} if turn is None else {turn[0]: turn[1]}
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sized = classes.select("cls", "cid", "v", F.size("v").cast("long").alias("size"), norm.alias("norm"))
    items = cut_lineage(by_length(sized).withColumn("segment", F.floor(F.col("place") / SEGMENT)).drop("place"))
    asking = by_length(sized.join(asked, "cls", "left_semi"))
    asking = cut_lineage(asking.withColumn("block", F.floor(F.col("place") / QUERIES)).drop("place"))
    best = classes.sparkSession.createDataFrame([], "q long, cls long, cid long, score long")
    last = items.agg(F.max("segment")).first()[0]
    begin = 0
    while last is not None and begin <= last:
        end = 2 * begin + 1
        full = best.groupBy("q").agg(F.min("score").cast("double").alias("_least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == keep)
        known = asking.join(full.select(F.col("q").alias("cls"), "_least"), "cls", "left")
        known = known.withColumn("least", F.coalesce("_least", F.lit(float("-inf"))))
        # The length from which on a candidate can serve a query; any will do where the threshold is not positive.
        need = F.when(F.col("least") <= 0, F.lit(0.0)).otherwise(F.col("least") / F.col("norm") * (1 - 1e-9))
        needs = known.groupBy("size", "block").agg(F.min(need).alias("need"))
        needs = needs.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("block", "need"))).alias("needs"))
        some = join_by_group(items.where((F.col("segment") >= begin) & (F.col("segment") < end)), needs, ["size"], ["cls"])
        blocks = F.transform(F.filter("needs", lambda n: n["need"] <= F.col("norm")), lambda n: n["block"])
        some = some.withColumn("block", F.explode(blocks))
        cells = [*TASK, "cls", "cid", "v", "norm"]
        offered = some.select(*cells, F.lit(False).alias("asks"), F.lit(0.0).alias("least"))
        queries = known.join(some.select(*TASK).distinct(), ["size", "block"]).select(*cells, F.lit(True).alias("asks"), "least")
        dealt = queries.unionByName(offered).repartition(*TASK).sortWithinPartitions(*TASK, F.desc("asks"), F.desc("norm"), "cls")
        found = dealt.drop("norm").mapInArrow(lambda batches: _meet(batches, turns, keep), "q long, cls long, cid long, score long")
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid", "cls"))
        best = cut_lineage(best.unionByName(found).withColumn("_rank", order).where(F.col("_rank") <= keep).drop("_rank"))
        begin = end
    return best


def top_products(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its largest inner products."""
    rows = integers(vectors, vector)
    classes = cut_lineage(classes_of(rows, nearest + 1).withColumn("cls", F.monotonically_increasing_id()))
    asking = rows.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    asking = cut_lineage(asking.join(classes.select("v", "cls"), "v").select("query_id", F.col("cls").alias("q")))
    found = search(classes, asking.select(F.col("q").alias("cls")).distinct(), nearest + 1)
    each = found.join(classes.select("cls", "ids"), "cls").select("q", "cls", "score", F.explode("ids").alias("vec_id"))
    pairs = asking.join(each, "q").where("query_id <> vec_id OR q <> cls")
    order = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", order).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.v <> c.v)
  WHERE q.vec_id % {EVERY} = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""
