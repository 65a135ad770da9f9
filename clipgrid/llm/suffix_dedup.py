"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or in the
same one before. In a suffix array the longest factor that starts earlier is shared with the nearest suffix above or
below whose position is smaller (previous and next smaller value), so each suffix needs to look at two others only.

One suffix array of everything fits no task, so suffixes are dealt out such that strings that can match meet:

1. Every string of LENGTH bytes has one *anchor*, the ``GRAM`` bytes in it whose hash is least. Neighbouring strings
   share theirs, so there is about one anchor per 40 bytes, and equal strings have equal anchors at equal places.
   Only hashes of the anchor and of its *stretch* (the union of its strings) are shuffled. Equal stretches are combined
   within a task first: all but the first are known to repeat, so a stretch that a third of all documents hold is
   one row per task.
2. Where anchors meet, equal stretches leave their first; where one anchor has several different stretches, these first
   ones are asked for. A few hundredths of the text are.
3. The documents hand over the bytes of those stretches.
4. Stretches of one anchor meet in a task, whose strings are sorted (suffixes, up to LENGTH bytes), and previous and next
   smaller positions give the matches. An anchor with more than ``CROWD`` different stretches (a common line with ever
   other surroundings) would make a large task; each of its strings is dealt out by its own hash instead, and all but
   the first of equal ones repeat.
5. All found intervals return to their documents.

Texts are handled as UTF-8 bytes, whole; very long ones in chunks that overlap. Null texts are empty, and texts below LENGTH
bytes lose nothing. A document with a null id counts as one with an id of 2^62 or more, 62 bits of a hash of its text; such
documents come after all others unless real ids are as large. Those with equal ids come in the order of 32 bits of a hash of
their text, which also tells them apart; of rows equal in both the first counts and the others are copies. Hash widths: 48 bits
bring strings together, 64 bits stand for equal stretches. All other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import starts_of, utf8, whole_groups
from clipgrid.session import cut_lineage

LENGTH, GRAM = 100, 20
#: K-grams of a string; bytes that are hashed at once; anchors that are combined before they are shuffled.
SPAN, CHUNK, COMBINED = LENGTH - GRAM + 1, 1 << 19, 1_000_000
FOUND = ["doc", "at", "a", "many"]
#: Different stretches of an anchor that meet in one task, by memory: some 40 strings each, 6 numbers a string, about 60 MB. Beyond it
#: a stretch becomes some 40 rows, so this path is for what one task cannot hold.
CROWD = 16_384
#: Ids of documents without one begin here.
_NAMELESS = 1 << 62
_SEED = 42
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    power, hashes, done, at = _U(0x9E3779B97F4A7C15), data.astype(_U) + _U(1), 1, {}
    while True:
        at[done] = (hashes, power)
        if 2 * done > GRAM:
            break
        hashes, done = hashes[:-done] * power + hashes[done:], 2 * done
        power = (np.array([power]) * power)[0]  # wraps around
    while done < GRAM:  # add the rest from shorter ones
        step = max(s for s in at if s <= GRAM - done)
        short, p = at[step]
        hashes = hashes[: len(short) - done] * p + short[done : done + len(hashes)][: len(short) - done]
        done += step
    return _mixed(hashes)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last string start of each anchor. ``ends``: where the text of each byte ends."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(_U), none, none, none
    hashes = gram_hashes(data)
    low = hashes >> _U(24) << _U(24) | np.arange(len(hashes), dtype=_U)  # the first of equals is least
    width = 1
    while 2 * width <= SPAN:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if SPAN > width:
        low = np.minimum(low[: width - SPAN], low[SPAN - width :])
    place = (low[:n] & _U((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + LENGTH <= ends[:n])
    if not len(starts):
        return hashes[:0], starts, starts, starts
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes[place[first]], place[first], starts[first], starts[last]


def united(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals by row: row, begin, end of its maximal runs."""
    if not len(row):
        return row, begin, end
    left, right = (row.astype(np.int64) << 32) + begin, (row.astype(np.int64) << 32) + end
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    new = np.ones(len(left), bool)
    new[1:] = left[1:] > right[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(left)) - 1
    return left[at] >> 32, left[at] & 0xFFFFFFFF, right[last] & 0xFFFFFFFF


class _Stretches:
    """Anchors of one task, combined."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def flush(self) -> pa.RecordBatch | None:
        """Rows a, hash, doc, at: an anchor that is first here, or (a < 0) an interval that repeats."""
        if not self.parts:
            return None
        a, h, doc, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.count = [], 0
        key = _mixed(a.view(_U)) ^ h.view(_U)
        order = np.lexsort((at, doc, key))
        a, h, doc, at = a[order], h[order], doc[order], at[order]
        first = starts_of(a, h)
        again = ~first & starts_of(a, h, doc, at)  # rows of a repeated document are one
        cells = [a[first], h[first], doc[first], at[first]]
        if again.any():
            d, t, begin, end = repeats(doc[again], at[again], a[again])
            spread = -1 - (_mixed(d.view(_U)) >> _U(20)).astype(np.int64)
            more = [spread, end, d, t << 31 | begin]
            cells = [np.concatenate(x) for x in zip(cells, more, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["a", "hash", "doc", "at"])


def repeats(doc: np.ndarray, at: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, tag, begin and end of the bytes that the strings of these anchors cover, united by document."""
    tag, place = at >> 31, at & 0x7FFFFFFF
    begin = place - (a >> 7 & 127)
    end = begin + (a & 127) + LENGTH
    order = np.lexsort((tag, doc))
    first = starts_of(doc[order], tag[order])
    row = np.empty(len(doc), np.int64)
    row[order] = np.cumsum(first) - 1
    one = order[first]
    r, begin, end = united(row, begin, end)
    return doc[one][r], tag[one][r], begin, end


def find_anchors(docs: DataFrame) -> DataFrame:
    """a (48 bits of the anchor's hash, 7 of its place in the stretch, 7 of the stretch's strings), hash, doc, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Stretches()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for some in _pieces(texts):
                for part in _anchor_rows(ids, texts, some):
                    held.parts.append(part)
                    held.count += len(part[0])
                if held.count >= COMBINED:
                    yield held.flush()
        rest = held.flush()
        if rest:
            yield rest

    return docs.mapInArrow(run, "a long, hash long, doc long, at long")


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, begin, end) of about CHUNK bytes; chunks of one text overlap by one byte less than a string."""
    some: list[tuple[int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for begin in range(0, len(text) - LENGTH + 1, CHUNK):
            end = min(len(text), begin + CHUNK + LENGTH - 1)
            some.append((i, begin, end))
            size += end - begin
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def _anchor_rows(ids: np.ndarray, texts: list[bytes], some: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    joined = b"".join(texts[i][b:e] for i, b, e in some)
    sizes = np.array([e - b for _, b, e in some], np.int64)
    stops = np.cumsum(sizes)
    hashes, place, first, last = anchors(np.frombuffer(joined, np.uint8), np.repeat(stops, sizes))
    if not len(hashes):
        return
    piece = np.searchsorted(stops, place, side="right")
    digest = np.fromiter((xxh3_64_intdigest(joined[p:q]) for p, q in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), _U, len(first))
    tags = np.array([xxh64_intdigest(texts[i], _SEED) & 0xFFFFFFFF for i, _, _ in some], np.int64)
    offset = np.array([b for _, b, _ in some], np.int64) - (stops - sizes)
    a = (hashes >> _U(16) << _U(14)).astype(np.int64) | (place - first) << 7 | (last - first)
    doc = ids[np.array([i for i, _, _ in some])][piece]
    yield a, digest.view(np.int64), doc, tags[piece] << 31 | (place + offset[piece])


def meet(found: DataFrame) -> DataFrame:
    """doc, at, a, many: with a < 0 an interval of -a bytes from ``at`` that repeats; else a stretch that is asked for, and
    how many different ones its anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, lambda t: t.column("a").to_numpy() >> 14):
            a, h, doc, at = (table.column(c).to_numpy() for c in ("a", "hash", "doc", "at"))
            known = a < 0
            if known.any():
                begin = at[known] & 0x7FFFFFFF
                yield _intervals(doc[known], at[known] >> 31, begin, h[known])
                a, h, doc, at = (x[~known] for x in (a, h, doc, at))
            if not len(a):
                continue
            first = starts_of(a, h)
            group = np.cumsum(starts_of(a >> 14)) - 1
            many = np.bincount(group, weights=first).astype(np.int64)[group]
            again = ~first & starts_of(a, h, doc, at)
            if again.any():
                yield _intervals(*repeats(doc[again], at[again], a[again]))
            ask = first & (many > 1)
            if ask.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[ask]) for x in (doc, at, a, many)], FOUND)

    dealt = found.repartition(F.shiftright("a", 14)).sortWithinPartitions("a", "hash", "doc", "at")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def _intervals(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    cells = (doc, tag << 31 | begin, begin - end, np.zeros(len(doc), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], FOUND)


def with_texts(docs: DataFrame, wanted: DataFrame, rest: list[str]) -> DataFrame:
    """Texts (compressed) and the rows of ``wanted`` in one partition and in order: doc, tag, the text's row, then at."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        codec = pa.Codec("zstd")
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = utf8(part.column(1))
                tags = pa.array([xxh64_intdigest(t, _SEED) & 0xFFFFFFFF for t in texts], pa.int64())
                packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), tags, sizes, packed, *part.columns[2:]], ["doc", "tag", "size", "packed", *rest])

    kinds = ", ".join(["doc long, tag long, size long, packed binary", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    texts = docs.select("doc", "text", *rest).mapInArrow(pack, kinds)
    asked = wanted.select("doc", F.shiftright("at", 31).alias("tag"), "at", "a", "many")
    both = texts.unionByName(asked, allowMissingColumns=True)
    return both.repartition("doc", "tag").sortWithinPartitions("doc", "tag", F.col("size").isNull(), "at")


def hand_over(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """k, hash, doc, at, a and the bytes of every stretch that is asked for.

    Of an anchor with a crowd of stretches come single strings by their hashes (k < 0, no bytes); those of one task are
    combined, and what repeats in it comes as intervals (a < 0).
    """
    names = ["k", "hash", "doc", "at", "a", "bytes"]
    crowd = CROWD

    def strings(held: _Stretches) -> pa.RecordBatch:
        a, h, d, p = (c.to_numpy() for c in held.flush().columns)
        known = a < 0
        cells = (np.where(known, a, -2 - (a >> 14)), np.where(known, 0, h), d, p, np.where(known, (p & 0x7FFFFFFF) - h, 0))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), pa.nulls(len(a), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        codec, held = pa.Codec("zstd"), _Stretches()
        text, packed, size = b"", None, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "size", "at", "a", "many")]
            cells = batch.column(batch.schema.get_field_index("packed"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, (d, n, p, x, many) in enumerate(zip(*columns, strict=True)):
                if n is not None:
                    packed, size = cells[i], n
                    continue
                if packed is not None:
                    text, packed = codec.decompress(packed.as_buffer(), size, asbytes=True), None
                begin = (p & 0x7FFFFFFF) - (x >> 7 & 127)
                if many > crowd:
                    own = [text[s : s + LENGTH] for s in range(begin, begin + (x & 127) + 1)]
                    first = np.array([xxh64_intdigest(s) >> 16 << 14 for s in own], np.int64)
                    other = np.array([xxh3_64_intdigest(s) for s in own], _U).view(np.int64)
                    place = (p >> 31 << 31) + np.arange(begin, begin + len(own))
                    held.parts.append((first, other, np.full(len(own), d, np.int64), place))
                    held.count += len(own)
                    continue
                for column, value in zip(out, (x >> 14, d, p, x, text[begin : begin + (x & 127) + LENGTH]), strict=True):
                    column.append(value)
            if out[0]:
                k, d, p, x = (pa.array(c, pa.int64()) for c in out[:4])
                yield pa.RecordBatch.from_arrays([k, pa.array(np.zeros(len(k), np.int64)), d, p, x, pa.array(out[4], pa.binary())], names)
            if held.count >= COMBINED:
                yield strings(held)
        if held.count:
            yield strings(held)

    return with_texts(docs, asked, []).mapInArrow(run, "k long, hash long, doc long, at long, a long, bytes binary")


def smaller_before(position: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element that is smaller, else -1."""
    found = np.arange(len(position)) - 1
    while True:
        larger = np.flatnonzero((found >= 0) & (position[found] >= position))
        if not len(larger):
            return found
        found[larger] = found[found[larger]]


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that share LENGTH bytes with another of their group, in suffix order, and a number for each such class.

    Words of eight bytes are compared from left to right; a string that is alone so far needs no further word.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    alive, cls = np.arange(len(starts)), group
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        word = words[starts[alive] + offset].astype(_U)
        order = np.lexsort((word, cls))
        alive, cls, word = alive[order], cls[order], word[order]
        first = starts_of(cls, word)
        ends = np.append(first[1:], True)
        shared = ~(first & ends)
        cls = (np.cumsum(first) - 1)[shared]
        alive = alive[shared]
        if not len(alive):
            break
    return alive, cls


def previous_factors(table: pa.Table) -> pa.RecordBatch | None:
    """The intervals whose strings of LENGTH bytes start earlier in the stretches of the same anchor."""
    k, doc, at, a = (table.column(c).to_numpy() for c in ("k", "doc", "at", "a"))
    cells = pa.concat_arrays(table.column("bytes").chunks)
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2], np.uint8)
    count = (a & 127) + 1
    row = np.repeat(np.arange(len(k)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    # The anchor lies at the same place in equal strings.
    group = np.cumsum(starts_of(k))[row] * 128 + (a >> 7 & 127)[row] - step
    alive, cls = suffix_order(data, offsets[row] + step, group)
    if not len(alive):
        return None
    row, step = row[alive], step[alive]
    tag, begin = at >> 31, (at & 0x7FFFFFFF) - (a >> 7 & 127)
    order = np.lexsort((tag, doc))
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum(starts_of(doc[order], tag[order])) - 1
    position = (number[row] << 31) + begin[row] + step
    order = np.lexsort((position, cls))  # equal in all LENGTH bytes: any order is a suffix order
    position, cls, row, step = position[order], cls[order], row[order], step[order]
    before = smaller_before(position)
    after = len(position) - 1 - smaller_before(position[::-1])[::-1]
    earlier = (before >= 0) & (cls[before] == cls)
    earlier |= (after < len(position)) & (cls[np.minimum(after, len(position) - 1)] == cls)
    if not earlier.any():
        return None
    row, step = row[earlier], step[earlier]
    start = begin[row] + step
    r, start, end = united(number[row], start, start + LENGTH)
    some = np.empty(number.max() + 1, np.int64)
    some[number] = np.arange(len(number))
    return _intervals(doc[some[r]], tag[some[r]], start, end)


def match(stretches: DataFrame) -> DataFrame:
    """doc, at, a: intervals that repeat, from stretches of the same anchor and from single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "k", 60_000, 8 << 20):
            k, h, doc, at, a = (table.column(c).to_numpy() for c in ("k", "hash", "doc", "at", "a"))
            known = a < 0
            if known.any():
                begin = at[known] & 0x7FFFFFFF
                yield _intervals(doc[known], at[known] >> 31, begin, begin - a[known])
            single = (k < 0) & ~known
            if single.any():
                k, h, doc, at, a = (x[single] for x in (k, h, doc, at, a))
                again = ~starts_of(k, h) & starts_of(k, h, doc, at)
                if again.any():
                    yield _intervals(*repeats(doc[again], at[again], a[again]))
            rest = table.filter(pa.array(~known & ~single))
            found = previous_factors(rest) if rest.num_rows else None
            if found is not None:
                yield found

    dealt = stretches.repartition("k").sortWithinPartitions("k", "hash", "doc", "at")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without bytes of characters that they hold in part."""
    found = []
    for begin, end in spans:
        while begin < end and text[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            found.append((begin, end))
    return found


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all but the text), n_bytes, spans (begin and end of what goes) and kept (binary).

    With ``whole_characters`` a character stays unless all its bytes go, so that what is kept is a text.
    """
    rest = [c for c in (keep if keep is not None else docs.columns) if c not in (text, "n_bytes", "spans", "kept")]
    names = [f"_c{i}" for i in range(len(rest))]
    content = F.col(text).cast("string")
    nameless = F.xxhash64(content).bitwiseAND(F.lit(_NAMELESS - 1)).bitwiseOR(F.lit(_NAMELESS))
    doc = F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc")
    rows = docs.select(doc, content.alias("text"), *(F.col(c).alias(n) for c, n in zip(rest, names, strict=True)))
    known = cut_lineage(meet(find_anchors(rows.select("doc", "text"))))
    matched = match(hand_over(rows, known.where("a >= 0")))
    intervals = known.where("a < 0").unionByName(matched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for table in whole_groups(batches, "doc", 50_000, 8 << 20):
            size = table.column("size").combine_chunks()
            is_text = size.is_valid().to_numpy(zero_copy_only=False)
            doc, tag = table.column("doc").to_numpy(), table.column("tag").to_numpy()
            row = np.cumsum(starts_of(doc, tag)) - 1
            other = np.flatnonzero(~is_text)
            at, a = (table.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("at", "a"))
            begin = at[other] & 0x7FFFFFFF
            r, begin, end = united(row[other], begin, begin - a[other])
            cuts = np.searchsorted(r, np.arange(row[-1] + 2))
            texts = np.flatnonzero(is_text)
            packed = table.column("packed").combine_chunks()
            spans, kept, sizes = [], [], []
            last = -1
            for i in texts.tolist():
                n = size[i].as_py()
                if row[i] == last:  # the same row once more is a copy
                    own = [(0, n)] if n >= LENGTH else []
                else:
                    own = list(zip(begin[cuts[row[i]] : cuts[row[i] + 1]].tolist(), end[cuts[row[i]] : cuts[row[i] + 1]].tolist(), strict=True))
                last = row[i]
                whole = codec.decompress(packed[i].as_buffer(), n, asbytes=True) if n else b""
                if whole_characters:
                    own = _whole_characters(whole, own)
                edges = [0, *(x for span in own for x in span), n]
                kept.append(b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                spans.append(own)
                sizes.append(n)
            part = table.take(pa.array(texts))
            ends = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
            b = pa.array([x[0] for own in spans for x in own], pa.int64())
            e = pa.array([x[1] for own in spans for x in own], pa.int64())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([b, e], ["begin", "end"]))
            cells = [*(part.column(n).combine_chunks() for n in names), pa.array(sizes, pa.int64()), listed, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cells], [*names, "n_bytes", "spans", "kept"])

    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(rest, names, strict=True)]
    joined = with_texts(rows, intervals, names)
    found = joined.mapInArrow(run, ", ".join([*kinds, "n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"]))
    return found.select(*(F.col(n).alias(c) for c, n in zip(rest, names, strict=True)), "n_bytes", "spans", "kept")


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
