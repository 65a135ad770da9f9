"""Groups of near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

``simhash_and_copies`` first groups documents by their SimHash fingerprints as in ``simhash``, with pigeonring candidates and the
Hamming check; all these links stay. ``grouped`` goes without. One 64-bit SimHash does not find every near copy: at a similarity of
0.8 two fingerprints differ in about 10 bits of 64, and in 17 or more for one pair in a hundred, which no cut of 64 bits into equal
segments can tell from chance. Further candidates therefore come from ``BANDS`` fingerprints of ``ROWS`` minimal shingle hashes
each: a pair at 0.8 shares none of them once in 17,000 times, a closer one less often. Every one of these pairs is then compared by
its whole shingle sets, so none below 0.8 is linked.

*Size.* Texts of the same words are one row before any of this. The smallest text of a bucket of equal fingerprints is its pivot.
Every text that is not yet in the group of the smallest of its pivots is first compared with that one, which joins a large group
of copies with one pair per row; then with those of its other pivots that are still in another group. Only buckets whose rows are
after that in several groups are compared pair by pair, in blocks, between groups and where the minima promise ``PROMISE`` or more; what a block hands on is a
spanning forest of its links, not its pairs. Shingle sets are made once, and only of
texts that share a bucket with another; the minima travel with these last buckets only.

Words are lower-cased ASCII words as in ``simhash``; a text of at most five words is one shingle. Null and empty texts are one
group. A null doc_id is an id like any other; repeated rows are in one group, and each gets its row. Columns other than doc_id and
text are not read, so their names may clash with those used here. An empty table has no groups. Very long texts are taken whole:
one task holds one text's hashes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices, starts_of, utf8, whole_groups
from clipgrid.llm.components import components
from clipgrid.llm.simhash import fingerprint
from clipgrid.llm.simhash import links as simhash_links
from clipgrid.session import cut_lineage

SHINGLE, SEED, BANDS, ROWS = 5, 42, 32, 6
#: Share of equal minima from which a pair is compared in full; 0.8 stays under it once in 20,000 times.
PROMISE = 0.68
#: Texts that one block of a comparison holds.
BLOCK = 2048
#: Shingles that one block of a comparison holds, about; 8 bytes each.
HASHES = 1 << 21

_random = np.random.default_rng(5)
_TURN, _FACTOR, _MIX = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
_SALT = _random.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of all words, and the distinct hashes of the shingles, in order."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    whole = xxh64_intdigest(joined, SEED)
    if len(words) <= width:
        return whole, np.array([whole], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = begins + sizes
    cut = zip(begins[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    found = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cut), np.uint64, len(words) - width + 1)
    return whole, np.unique(found)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each of BANDS * ROWS orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ _TURN) * _FACTOR).min(axis=0))
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), cid (a hash of its words), SimHash fp, n shingles, a byte per minimum, keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in small_slices(batches, "text"):
            tags, cids, prints, sizes, marks, keys = [], [], [], [], [], []
            for text in utf8(batch.column(1)):
                whole, hashes = shingles(text)
                least = minima(hashes)
                tags.append(xxh64_intdigest(text, SEED))
                cids.append(whole)
                prints.append(fingerprint(text))
                sizes.append(len(hashes))
                marks.append((least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes())
                keys.append((least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + _SALT)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ends = pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))
            cells = [batch.column(0), signed(tags), signed(cids), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "tag", "cid", "fp", "n", "marks", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, tag long, cid long, fp long, n long, marks binary, keys array<long>")


def _sets(docs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """cid and its shingle hashes for every cid of ``texts``, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_slices(batches, "text"):
            for text in utf8(batch.column(0)):
                whole, hashes = shingles(text)
                if whole in seen:  # a row that repeats
                    continue
                seen.add(whole)
                cid = pa.array(np.array([whole], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([cid, pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], ["cid", "hashes"])

    place = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("p")
    wanted = prints.join(texts.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(place)
    # Written, so that its size is known when the join is planned: the texts are shuffled only if it is large.
    wanted = cut_lineage(wanted.select(F.col("p.doc_id").alias("_doc"), F.col("p.tag").alias("_tag")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = rows.join(wanted, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    return rows.select("text").mapInArrow(run, "cid long, hashes array<long>").dropDuplicates(["cid"])


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b of cids whose shingle sets have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return cut_lineage(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))  # shared / union >= 4 / 5


def _linked(cid, root, size, marks, block, first, second, sets) -> list[tuple[int, int]]:
    """Links between two blocks of a bucket: pairs of different groups that reach the similarity, without those that earlier links imply."""
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    above: dict[int, int] = {}

    def top(group: int) -> int:
        while (up := above.get(group, group)) != group:
            above[group] = group = above.get(up, up)
        return group

    found = []
    step = max(1, (1 << 17) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
        good = (root[i] != root[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
        if first == second:
            good &= i < j
        i, j = i[good], j[good]
        near = (marks[i] == marks[j]).mean(axis=1) >= PROMISE if len(i) else good[:0]
        for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
            one, other = top(int(root[p])), top(int(root[q]))
            if one == other:
                continue
            shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 9 * shared >= 4 * (len(sets[p]) + len(sets[q])):  # shared / union >= 4 / 5
                above[one] = other
                found.append((int(cid[p]), int(cid[q])))
    return found


def across(buckets: DataFrame, marks: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between different groups in the buckets (key, cid, n, root), a spanning forest of each pair of blocks.

    A block has about ``block`` texts, and fewer if they are long: a task holds their minima and shingle sets.
    """
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_words"))
    parts = F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_words") / HASHES))
    sizes = sizes.select(F.col("key").alias("_key"), parts.alias("blocks"))
    met = buckets.join(sizes, F.col("key") == F.col("_key")).withColumn("block", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("key", "cid", "n", "root", "block", other.alias("other"))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")
    met = met.withColumn("task", F.xxhash64("key", "first", "second")).join(marks, "cid").join(sets, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "task", 50_000):
            names = ("task", "key", "first", "second", "cid", "root", "n", "block")
            task, key, first, second, cid, root, size, own = (group.column(c).to_numpy() for c in names)
            least = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(cid), -1)
            lists = group.column("hashes").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            hashes = [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            begins = np.flatnonzero(starts_of(task, key, first, second))
            links: list[tuple[int, int]] = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(cid)], strict=True):
                part = slice(a, b)
                links += _linked(cid[part], root[part], size[part], least[part], own[part], first[a], second[a], hashes[part])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    columns = ("task", "key", "first", "second", "cid", "root", "n", "block", "marks", "hashes")
    dealt = met.select(*columns).repartition("task").sortWithinPartitions("task", "key", "first", "second", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are not yet in one group."""
    of = lambda c: roots.select(F.col("cid").alias(c), F.col("root").alias(f"_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    return cut_lineage(components(links).withColumnRenamed("node", "cid"))


def by_simhash(prints: DataFrame) -> DataFrame:
    """a, b: links that connect the texts of each SimHash group, each text with the smallest of its fingerprint and these in a forest."""
    least = cut_lineage(prints.groupBy("fp").agg(F.min("cid").alias("least")))
    same = prints.join(least, "fp").where("cid <> least").select(F.col("least").alias("a"), F.col("cid").alias("b")).distinct()
    of = lambda c: least.select(F.col("fp").alias(f"_{c}"), F.col("least").alias(c))
    pairs = simhash_links(least.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return cut_lineage(same.unionByName(pairs.join(of("a"), "_a").join(of("b"), "_b").select("a", "b")))


def simhash_and_copies(docs: DataFrame) -> DataFrame:
    """What :func:`grouped` gives, with SimHash groups joined first and kept."""
    return grouped(docs, first_links=by_simhash)


def grouped(docs: DataFrame, block: int = BLOCK, first_links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, tag, and root, which rows of one group share; one row per document.

    ``first_links`` gives links between cids from the sketches; they hold whatever the shingle sets say.
    """
    prints = cut_lineage(sketches(docs))
    keyed = lambda rows: rows.select("cid", "n", F.explode("keys").alias("key"))
    pivots = keyed(prints).groupBy("key").agg(F.min(F.struct("cid", "n")).alias("p"), F.max("cid").alias("_last")).where("p.cid <> _last")
    pivots = cut_lineage(pivots.select("key", "p"))
    met = cut_lineage(keyed(prints.dropDuplicates(["cid"])).join(pivots, "key").where("cid <> p.cid").select("key", "cid", "n", "p"))
    close = 5 * F.least("n", "p.n") >= 4 * F.greatest("n", "p.n")
    pairs = cut_lineage(met.where(close).select(F.col("p.cid").alias("a"), F.col("cid").alias("b")).distinct())
    # Every later pair is of texts that met a pivot, so each shingle set is made once.
    sets = cut_lineage(_sets(docs, prints, met.select("cid").unionByName(pairs.select(F.col("a").alias("cid")))))
    # After SimHash each text meets the smallest of its pivots, then the other pivots that this has not brought into its group.
    first = cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    if first_links is None:
        links = verified(sets, first)
    else:
        near = first_links(prints)
        links = near.unionByName(verified(sets, cut_lineage(_apart(first, _roots(near)))))
    roots = _roots(links)
    second = cut_lineage(_apart(pairs.join(first, ["a", "b"], "left_anti"), roots))
    links = links.unionByName(verified(sets, second))
    roots = _roots(links)
    # Only buckets whose other texts are in several groups have pairs left, and only their rows need the minima.
    buckets = met.select("key", "cid", "n").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    several = buckets.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    buckets = cut_lineage(buckets.join(several, "key", "left_semi"))
    marks = prints.join(buckets.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"]).select("cid", "marks")
    links = links.unionByName(cut_lineage(across(buckets, cut_lineage(marks), sets, block)))
    roots = components(links).withColumnRenamed("node", "cid")
    return prints.select("doc_id", "tag", "cid").join(roots, "cid", "left").select("doc_id", "tag", F.coalesce("root", "cid").alias("root"))
