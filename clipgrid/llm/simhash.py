"""SimHash near-duplicates, with pigeonring filtering of candidates.

The fingerprint of a text is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints that differ
in at most ``RADIUS`` of 64 bits are linked, and linked documents form a group.

*Candidates.* The 64 bits are a ring of four segments of 16. If all differences are at most 3, some segment begins a
chain in which the first l segments together differ in at most ``l * 3 / 4`` bits, rounded down: 0, 1, 2, 3. The first
segment is therefore equal and the next differs in one bit at most, so that one half of it is equal too. Fingerprints
meet under eight keys: segment, and either half of the next. What meets must pass the rest of the chain from that segment
before the full Hamming distance is taken.

*Size.* Equal fingerprints are one row with the smallest doc_id before any of this, whatever their number. Keys with one
fingerprint are dropped. A key with many is cut into blocks, and pairs of blocks are compared apart, each pair by a vector
operation; a comparison returns a spanning forest of its links, not the links, which keeps every connection. Groups come
from alternating large-star and small-star steps over a table, written between rounds.

Null and empty texts have the fingerprint zero and link like any other. Repeated rows link to themselves. Documents with
a null doc_id take part; a group with no other id has the component null. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices, starts_of, utf8, whole_groups
from clipgrid.llm.components import components
from clipgrid.session import cut_lineage

SHINGLE, SEED, RADIUS = 3, 42, 3
SEGMENTS, WIDTH = 4, 16
#: Fingerprints that one block of a comparison holds.
BLOCK = 2048


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of lower-cased ASCII words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        ends = begins + sizes
        shingles = [joined[a:b] for a, b in zip(begins[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)
    return int(majority[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, and tag long (a hash of the text), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in small_slices(batches, "text"):
            texts = utf8(batch.column(1))
            found = pa.array([fingerprint(t) for t in texts], pa.int64())
            tags = pa.array(np.array([xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, tags], ["doc_id", "fp", "tag"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long, tag long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the links (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # every tree hooks its root to the smallest root that it meets
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _links(fps: np.ndarray, blocks: np.ndarray, segment: int, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the blocks ``first`` and ``second`` of one key, by chain and then by Hamming distance."""
    left, right = fps[blocks == first], fps[blocks == second]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.meshgrid(np.arange(at, min(at + step, len(left))), np.arange(len(right)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if first == second:
            below = i < j
            i, j = i[below], j[below]
        spent = np.zeros(len(i), np.uint8)
        for length in range(1, SEGMENTS + 1):
            shift = np.uint64(WIDTH * ((segment + length - 1) % SEGMENTS))
            mask = np.uint64((1 << WIDTH) - 1)
            spent = spent + _differ(left[i] >> shift & mask, right[j] >> shift & mask)
            within = spent <= length * RADIUS // SEGMENTS
            i, j, spent = i[within], j[within], spent[within]
        near = _differ(left[i], right[j]) <= RADIUS
        if near.any():
            found.append(forest(left[i[near]], right[j[near]]))
    if not found:
        none = np.empty(0, np.uint64)
        return none, none
    return forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """a and b: links that connect the distinct fingerprints ``fp`` as all pairs within RADIUS do."""
    fp = F.col("fp")
    keys = []
    for s in range(SEGMENTS):
        own = F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND((1 << WIDTH) - 1)
        following = F.shiftrightunsigned(fp, WIDTH * ((s + 1) % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)
        for half in (0, 1):
            part = F.shiftright(following, 8 * half).bitwiseAND(255)
            keys.append(F.shiftleft(own, 16) + F.shiftleft(part, 8) + F.lit(2 * s + half))
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "_key")
    met = keyed.join(sizes, F.col("key") == F.col("_key")).withColumn("blocks", F.ceil(F.col("n") / block))
    met = met.withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")))
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("key", "fp", "block", pair.alias("other")).select(
        "key", "fp", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    met = met.withColumn("task", F.xxhash64("key", "first", "second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "task", 50_000):
            key, first, second, block_of = (group.column(c).to_numpy() for c in ("key", "first", "second", "block"))
            fps = group.column("fp").to_numpy().view(np.uint64)
            begins = np.flatnonzero(starts_of(group.column("task").to_numpy(), key, first, second))
            ends = np.append(begins[1:], len(fps))
            out = [
                _links(fps[a:b], block_of[a:b], int(key[a] & 255) // 2, first[a], second[a])
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True)
                if b - a > 1
            ]
            if out:
                a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = met.repartition("task").sortWithinPartitions("task", "key", "first", "second", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, tag, and root, which rows of one group share; one row per document."""
    prints = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select("fp"))
    groups = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    return prints.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document."""
    rows = cut_lineage(grouped(docs))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = grouped) -> DataFrame:
    """The rows of ``docs`` that stay: of each group that of the smallest doc_id, one row where it repeats.

    Of rows with equal doc_id and text the one with the least hash of its other columns (maps left out) stays. Only such rows are
    shuffled with their texts, as long as the ids of those that stay are few enough to be sent to the tasks.
    """
    rows = groups(docs).groupBy("root", "doc_id", "tag").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "times")
    first = rows.groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.tag", "p.times")
    first = cut_lineage(first.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "times"))
    own = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_text", F.xxhash64(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_tag"))
    single = own.join(first.where("times = 1"), same, "left_semi")
    several = own.join(first.where("times > 1"), same, "left_semi")
    hashed = [F.col("_row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    least = F.row_number().over(Window.partitionBy("_row.doc_id", "_text").orderBy(F.xxhash64(*hashed)))
    several = several.withColumn("_once", least).where("_once = 1").drop("_once")
    return single.unionByName(several).select("_row.*")
