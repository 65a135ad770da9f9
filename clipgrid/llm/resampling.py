"""Quality by importance resampling.

Two generative models over hashed word uni- and bigrams, one of the target texts and one of all raw texts, give each
document the logarithm of how much likelier the target model makes it: the sum over all its n-grams. Where length should weigh
less, ``reference`` lets a text count as at most so many n-grams of its own mean. Adding seeded Gumbel noise and taking the
``share`` of documents with the largest sums draws without replacement in proportion to those importance weights.

Raw counts cover every text: each task sends one row per bucket, whatever it read. The target is a bounded sample of the
labelled rows, ``TARGETS`` ids of good documents, the smallest by hash, so no text is shuffled to find them. The table
of log ratios has ``BUCKETS`` numbers and travels with the tasks. The cut is the exact k-th largest key, found by range
partitions of ids and keys; noise is a hash of seed, id and text, so reruns agree.

Texts without words (null, empty) have a null weight, come last and are not kept. A document with any label 0 is no
target. Without targets all weights are zero and the draw is uniform. Repeated rows have equal keys and stand together.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices, utf8
from clipgrid.llm.ranks import global_rank
from clipgrid.session import cut_lineage

BUCKETS, TARGETS, SHARE, SEED = 1 << 14, 20_000, 0.8, 3
#: Distinct words after which a task forgets their hashes.
REMEMBERED = 500_000


class Grams:
    """Buckets of the words and word pairs of texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh32_intdigest

        words = text.lower().split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxh32_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] + np.uint32(0x7F4A7C15))
        both = np.concatenate([h, pairs])
        both = (both ^ both >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        return (both ^ both >> np.uint32(13)) % np.uint32(BUCKETS)


def target_ids(labels: DataFrame, most: int = TARGETS) -> list[int]:
    """The ids of at most ``most`` documents that are labelled good only."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    chosen = good.select("doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("o")).orderBy("o", "doc_id").limit(most)
    return sorted(r.doc_id for r in chosen.collect())


def log_ratios(docs: DataFrame, targets: list[int]) -> np.ndarray:
    """Log of target over raw probability per bucket, both with one added to each count."""
    wanted = np.array(targets, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in small_slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            is_target = np.isin(np.array([-1 if i is None else i for i in ids], np.int64), wanted) & np.array([i is not None for i in ids])
            for text, hit in zip(utf8(batch.column(1)), is_target.tolist(), strict=True):
                found = np.bincount(grams(text), minlength=BUCKETS)
                raw += found
                if hit:
                    target += found
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = docs.mapInArrow(run, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if not targets:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, reference: float | None = None) -> DataFrame:
    """doc_id, log_weight (null without words) and noise_key, an XXH64 of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        grams = Grams()
        for batch in small_slices(batches, "text"):
            texts = utf8(batch.column(1))
            found = [grams(t) for t in texts]
            weights = [float(ratios[g].mean() * min(len(g), reference or len(g))) if len(g) else None for g in found]
            keys = [xxh64_intdigest(b"%d:" % i + t if i is not None else t, SEED) >> 1 for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), pa.array(keys, pa.int64())], ["doc_id", "log_weight", "noise_key"])

    return docs.mapInArrow(run, "doc_id long, log_weight double, noise_key long")


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, most: int = TARGETS, reference: float | None = None) -> DataFrame:
    """doc_id, log_weight, key (weight plus noise), rank (from 1) and kept, one row per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Written, as dealing rows out by range reads them twice.
    weighed = cut_lineage(weigh(docs, log_ratios(docs, target_ids(labels, most)), reference))
    u = (F.shiftright("noise_key", 10) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    ranked = global_rank(keyed, -F.coalesce("key", F.lit(float("-inf"))), F.col("doc_id"), F.col("noise_key"))
    some = ranked.agg(F.count("log_weight")).first()[0]
    kept = (F.col("rank") < int(some * share + 0.5)) & F.col("log_weight").isNotNull()
    return ranked.select("doc_id", "log_weight", "key", (F.col("rank") + 1).alias("rank"), kept.alias("kept"))
