"""Spelling variants: words at an edit distance of one, by a dictionary of pairs of trie nodes.

Words are put into two tries, one read forwards and one read backwards, whose nodes are numbered. For each position of a word the
pair (node of what stands before, node of what stands after) is an entry: once with the letter at the position skipped, once with
nothing skipped, where a letter could be inserted. Two words that differ in one letter share the pair that skips it; a word with
one letter more has, where it skips that letter, the pair that the other one has where the letter is inserted. Nodes are numbered,
not hashed, so equal pairs are equal strings and the neighbours are exact. A letter in a run of equal ones is skipped only as the
last of them when it is inserted elsewhere, so every two words meet once.

*Numbers.* Words are dealt out by range and sorted. In a sorted partition a word shares with the one before it the nodes of their
common prefix, and its others are new. The nodes of the first word of a partition may be known from earlier partitions: one pass
over the first and last words of the partitions, one row each, tells their numbers. A number of a node grows with the order of the
words, so the node of the whole word is the word's number and its place in code-point order.

*Size.* Occurrences are counted where they are read and then summed, so a frequent word is a row per task. All words that share a
pair differ in one letter, so at most as many as the alphabet has letters meet under one key, 90 here; a word has at most about
180 neighbours per letter. Pairs are two integers, whatever the length of a word.

*Odd input.* Null texts have no words. A null doc_id is written as nothing before the colon. Repeated rows count as often as they
stand there. A text may be one word of any length. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices
from clipgrid.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT, TIMES, ONE_IN = 7, 2, 10, 31
LETTER = "A-Za-zÀ-ÿ"
#: Distinct words that a task holds before it hands them on, and characters of a text that are searched at once.
HELD, PIECE = 200_000, 1 << 20
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_RUN, _GAP = re.compile(f"[{LETTER}]{{{LEAST_LENGTH},}}"), re.compile(f"[^{LETTER}]")


def runs(text: str) -> Iterator[list[str]]:
    """All runs of at least LEAST_LENGTH letters, A to Z lower-cased, in lists; pieces end between runs."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > 2 * PIECE:
            gap = _GAP.search(text, at + PIECE)
            end = gap.start() if gap else end
        yield _RUN.findall(text[at:end].translate(_LOWER))
        at = end


def misspelt(word: str, start: int) -> str:
    """The word, without one letter where ONE_IN divides its checksum; ``start`` is the checksum of what stands before it."""
    h = zlib.crc32(word.encode(), start)
    if h % ONE_IN:
        return word
    drop = h % len(word)
    return word[:drop] + word[drop + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word and n: the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in small_slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for some in runs(text):
                    for word, n in Counter(some).items():
                        counts[misspelt(word, start)] += n
                    if len(counts) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                        counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _lists(paths: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, paths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(paths)))


def _steps(path: np.ndarray) -> np.ndarray:
    """The places at which the numbers along a path do not just go on by one (or minus one where they are negative)."""
    step = np.diff(path)
    follows = np.where(path[1:] < 0, (step == -1) & (path[:-1] < 0), (step == 1) & (path[:-1] > 0))
    return np.append(0, np.flatnonzero(~follows) + 1)


def _unfolded(places: list[int], numbers: list[int], size: int) -> np.ndarray:
    """The path of which ``_steps`` and the numbers there are given."""
    begins, values = np.array(places, np.int64), np.array(numbers, np.int64)
    each = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, size)))
    along = np.arange(size) - begins[each]
    return values[each] + np.where(values[each] < 0, -along, along)


def number_nodes(words: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and path array<long>: the number of each prefix of ``word`` from the first letter to the whole word."""
    ends = "made long, first string, last string, size long, places array<long>, numbers array<long>"
    names = [*keep, "path", "part", *(c.split()[0] for c in ends.split(", "))]
    types = {"made": pa.int64(), "first": pa.string(), "last": pa.string(), "size": pa.int64(), "places": pa.list_(pa.int64()), "numbers": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, first, before, path = TaskContext.get().partitionId(), 0, None, "", np.empty(0, np.int64)
        kept: list[pa.DataType] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                paths = []
                for word in some.column(0).to_pylist():
                    if first is None:
                        first, path = word, -1 - np.arange(len(word))  # not known here: minus the length of the prefix
                    else:
                        same = shared(before, word)
                        new = len(word) - same
                        path = np.append(path[:same], np.arange(made + 1, made + new + 1))
                        made += new
                    before = word
                    paths.append(path)
                kept = [c.type for c in some.columns[1:]]
                cells = [*some.columns[1:], _lists(paths), pa.array(np.full(len(paths), part)), *(pa.nulls(len(paths), t) for t in types.values())]
                yield pa.RecordBatch.from_arrays(cells, names)
        if first is not None:
            steps = _steps(path)
            last = [made, first, before, len(path), steps.tolist(), path[steps].tolist()]
            cells = [*(pa.nulls(1, t) for t in kept), pa.nulls(1, pa.list_(pa.int64())), pa.array([part])]
            yield pa.RecordBatch.from_arrays([*cells, *(pa.array([x], t) for x, t in zip(last, types.values(), strict=True))], names)

    # Equal starts stay together, so that the order of whole words is the order of partitions too.
    dealt = words.repartitionByRange(F.substring("word", 1, 256)).sortWithinPartitions("word")
    kinds = ", ".join([*(f"{c} {words.schema[c].dataType.simpleString()}" for c in keep), "path array<long>, part long", ends])
    placed = cut_lineage(dealt.select("word", *keep).mapInArrow(run, kinds))
    heads = cut_lineage(_heads(placed.where("path IS NULL").select("part", *types)))
    number = lambda x: F.when(x > 0, x + F.col("base")).otherwise(F.get("head", (-x - 1).cast("int")))
    rows = placed.where("path IS NOT NULL").select(*keep, "path", "part")
    return rows.join(heads, "part").select(*keep, F.transform("path", number).alias("path"))


def _heads(summaries: DataFrame) -> DataFrame:
    """part, base (nodes that were numbered before it) and head (the numbers along its first word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, before, path = 0, "", np.empty(0, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                same = shared(before, r["first"])
                new = len(r["first"]) - same
                head = np.append(path[:same], np.arange(count + 1, count + new + 1))
                count += new
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([count]), _lists([head])], ["part", "base", "head"])
                local = _unfolded(r["places"], r["numbers"], r["size"])
                path = np.where(local > 0, local + count, head[np.minimum(np.maximum(-local - 1, 0), len(head) - 1)])
                count, before = count + r["made"], r["last"]

    return summaries.coalesce(1).sortWithinPartitions("part").mapInArrow(run, "part long, base long, head array<long>")


def pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """p, s, w, n, kind: the entries of each word; kind 0 inserts, 1 skips a letter that equals the next one, 2 another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                w, n, ahead, behind, same = (batch.column(batch.schema.get_field_index(c)) for c in ("w", "n", "path", "back", "same"))
                size = np.diff(ahead.offsets.to_numpy())
                each = np.repeat(np.arange(len(size)), size + 1)  # one more: before the first letter, after the last one
                place = np.arange(len(each)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
                before, after = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
                before[place > 0] = ahead.flatten().to_numpy()
                turned = np.zeros(len(each), np.int64)
                turned[place > 0] = behind.flatten().to_numpy()  # by the length of the suffix
                begin = np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
                after = turned[begin + np.repeat(size, size + 1) - place]
                letter = place < np.repeat(size, size + 1)
                next_one = np.flatnonzero(letter) + 1
                kind = np.where(same.flatten().to_numpy(zero_copy_only=False), 1, 2)
                p = np.concatenate([before, before[letter]])
                s = np.concatenate([after, after[next_one]])
                who = np.concatenate([each, each[letter]])
                kinds = np.concatenate([np.zeros(len(each), np.int64), kind])
                cells = [p, s, w.to_numpy()[who], n.to_numpy()[who], kinds.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["p", "s", "w", "n", "kind"])

    both = forward.select("w", "n", "path", "same").join(backward.select("w", F.col("path").alias("back")), "w")
    return both.mapInArrow(run, "p long, s long, w long, n long, kind int")


def nearest(entries: DataFrame) -> DataFrame:
    """w, n_near, and best: n and minus w of its most frequent neighbour, ties to the first in order."""
    member = F.struct("w", "n", "kind")
    met = entries.groupBy("p", "s").agg(F.collect_list(member).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("m")
    each = met.select(F.explode("m").alias("own"), "m")
    near = lambda x: (x["w"] != F.col("own.w")) & (((x["kind"] > 0) & (F.col("own.kind") > 0)) | (x["kind"] + F.col("own.kind") == 2))
    seen = each.select(F.col("own.w").alias("w"), F.filter("m", near).alias("near")).where("size(near) > 0")
    best = F.array_max(F.transform("near", lambda x: F.struct(x["n"].alias("n"), (-x["w"]).alias("w"))))
    return seen.groupBy("w").agg(F.sum(F.size("near")).alias("n_near"), F.max(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """w and root, from w and form (never null): the end of the chain of forms, by doubling the steps."""
    now = forms.select("w", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("w").alias("_w"), F.col("root").alias("_root"))
        stepped = now.join(further, F.col("root") == F.col("_w"), "left")
        now = cut_lineage(stepped.select("w", F.coalesce("_root", "root").alias("root"), F.col("_w").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("w", "root")
        now = now.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    words = cut_lineage(count_words(docs))
    letters = F.split("word", "")
    same = F.transform(letters, lambda x, i: x.eqNullSafe(F.get(letters, (i + 1).cast("int"))))
    forward = number_nodes(words.withColumn("own", F.col("word")), ["own", "n"])
    forward = cut_lineage(forward.select(F.element_at("path", -1).alias("w"), F.col("own").alias("word"), "n", "path"))
    backward = number_nodes(forward.select(F.reverse("word").alias("word"), "w"), ["w"])
    entries = pairs(forward.select("w", "n", "path", same.alias("same")), backward)
    found = cut_lineage(nearest(entries))
    own = forward.select("w", "word", "n")
    rows = own.join(found, "w", "left")
    good = F.col("best.n") >= TIMES * F.col("n")
    rows = cut_lineage(rows.select("w", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, -F.col("best.w")).alias("form")))
    ends = roots(rows.where("form IS NOT NULL").select("w", "form"))
    names = rows.select(F.col("w").alias("_w"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    formed = rows.where("form IS NOT NULL").join(ends, "w")
    formed = formed.join(names, F.col("form") == F.col("_w")).drop("form", "_w").withColumnsRenamed({"_word": "form", "_n": "form_n"})
    formed = formed.join(names, F.col("root") == F.col("_w")).drop("root", "_w", "_n").withColumnRenamed("_word", "root")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    none = rows.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return formed.select(*columns).unionByName(none)

