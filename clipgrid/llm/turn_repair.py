"""Repair of conversations by a generalised LR parser with weighted edits.

The roles of a sound conversation form ``(s?(ua)+)?``: nothing, or turns of user and assistant after at most one system row.
An LR(0) automaton of that grammar reads the role initials. A row may be kept (0), given the role user or assistant (1) or
deleted (2, which blank and duplicate rows must be); a row without text may be inserted anywhere (5); a truncated row that is not
deleted costs 5 more. The parser follows all edits at once: a vertex of its graph-structured stack is a state and the vertex
below, which all stacks above it share, and stacks with equal tops are merged into the one of least (cost, audit). Left recursion
keeps the stack flat, so there are a handful of vertices.

*Size.* Only marks of rows are dealt out by range of (conversation, turn, role, text), so one conversation of any length spreads
over many tasks. Each run of at most ``SEGMENT`` rows gives, for each vertex that it may start from, the least edits to each vertex
it can end in. Such tables compose like the rows do, so the task of a conversation only has to walk its segments. SHA-256 cannot be
split, so the texts of one conversation do go through one task, in order and batch by batch: only its audit is held in memory.

Within a step the audits of different vertices are known by their rank alone. That decides ties, because audits of equally
many rows never are prefixes of each other: each ends with the edit of the last row.

*Odd input.* A null conv_id is a conversation. Rows of one conversation are taken by turn (nulls first), then role, first 64
characters and SHA-256 of the text, which makes identical rows neighbours. Null roles and texts are one space. A role whose
initial is not s, u or a, an empty one too, fits nowhere and is deleted or given another role. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import starts_of
from clipgrid.operators.skew import join_by_group
from clipgrid.session import cut_lineage

RULES = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "ua"), ("P", "Pua"))
START, ROLES, GIVEN = "S", {"s": "system", "u": "user", "a": "assistant"}, "ua"
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: A vertex this much dearer than the best one cannot win: one insertion ends an open pair, one opens one, one deletion drops a system row.
HOPELESS = 2 * INSERT + DELETE
SEGMENT = 1 << 16
#: Kinds of rows: initial s, u, a, another one; the same when truncated; those that must be deleted.
INITIALS, TRUNCATED, DELETED = "sua", 4, 8
_LEGAL = np.zeros((4, 4), bool)
for _pair in ("su", "ua", "au"):
    _LEGAL[INITIALS.index(_pair[0]), INITIALS.index(_pair[1])] = True

_BLANK = r"^[\x20\x09-\x0D]*$"
_CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"


class Parser:
    """LR(0) states, stack vertices, and the edits that lead from vertex to vertex."""

    def __init__(self) -> None:
        self.states = [self._closure({(r, 0) for r, (left, _) in enumerate(RULES) if left == START})]
        self.vertices: list[tuple[int, int]] = [(0, -1)]  # state, vertex below
        self.frontiers: list[tuple[tuple[int, int, int], ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int, tuple]] = {}

    @staticmethod
    def _closure(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            following = RULES[rule][1][dot : dot + 1]
            for r, (left, _) in enumerate(RULES):
                if left == following and (r, 0) not in found:
                    found.add((r, 0))
                    todo.append((r, 0))
        return frozenset(found)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(r, dot + 1) for r, dot in self.states[state] if RULES[r][1][dot : dot + 1] == symbol}
        if not moved:
            return None
        closed = self._closure(moved)
        if closed not in self.states:
            self.states.append(closed)
        return self.states.index(closed)

    def _push(self, below: int, state: int) -> int:
        vertex = (state, below)
        if vertex not in self.vertices:
            self.vertices.append(vertex)
        return self.vertices.index(vertex)

    def _reductions(self, vertex: int, of_start: bool) -> Iterator[int]:
        """Vertices below the right sides that end here, with the left side pushed (for the start symbol: not pushed)."""
        for rule, dot in self.states[self.vertices[vertex][0]]:
            left, right = RULES[rule]
            if dot < len(right) or (left == START) != of_start:
                continue
            below = vertex
            for _ in right:
                below = self.vertices[below][1]
            yield below if of_start else self._push(below, self._goto(self.vertices[below][0], left))

    def shifted(self, vertex: int, symbol: str) -> list[int]:
        """The tops after a symbol and all reductions that follow it."""
        state = self._goto(self.vertices[vertex][0], symbol)
        tops, todo = [], [] if state is None else [self._push(vertex, state)]
        while todo:
            top = todo.pop()
            tops.append(top)
            todo += [v for v in self._reductions(top, False) if v not in tops]
        return [t for t in tops if self.accepts(t) or any(self._goto(self.vertices[t][0], s) is not None for s in ROLES)]

    def accepts(self, vertex: int) -> bool:
        return any(below == 0 for below in self._reductions(vertex, True))

    @cache  # noqa: B019
    def inserted(self, vertex: int) -> dict[int, tuple[int, str]]:
        """Least cost and letters to each vertex that insertions reach."""
        best, todo = {vertex: (0, "")}, [vertex]
        while todo:
            v = todo.pop(0)
            for s in GIVEN:
                for top in self.shifted(v, s):
                    new = (best[v][0] + INSERT, best[v][1] + "I")
                    if top not in best or new < best[top]:
                        best[top] = new
                        todo.append(top)
        return best

    @cache  # noqa: B019
    def edges(self, vertex: int, kind: int) -> dict[int, tuple[int, str]]:
        """Least cost and letters to each vertex after insertions and one row of this kind."""
        best: dict[int, tuple[int, str]] = {}
        for v, (cost, letters) in self.inserted(vertex).items():
            tops = [(v, DELETE, "D")]
            if kind != DELETED:
                more = CUT_OFF if kind >= TRUNCATED else 0
                tops += [(t, RENAME + more, "R") for s in GIVEN for t in self.shifted(v, s)]
                if kind % TRUNCATED < len(INITIALS):
                    tops += [(t, more, "K") for t in self.shifted(v, INITIALS[kind % TRUNCATED])]
            for top, extra, letter in tops:
                new = (cost + extra, letters + letter)
                if top not in best or new < best[top]:
                    best[top] = new
        return best

    def number(self, frontier: tuple[tuple[int, int, int], ...]) -> int:
        if frontier not in self.numbers:
            self.numbers[frontier] = len(self.frontiers)
            self.frontiers.append(frontier)
        return self.numbers[frontier]

    def starting(self, vertex: int) -> int:
        return self.number(((vertex, 0, 0),))

    def move(self, number: int, kind: int) -> tuple[int, int, tuple]:
        """The next frontier, what its least cost adds, and for each of its tops the old one and the letters."""
        found = self.moves.get((number, kind))
        if found is None:
            new, spent, back = merged(self.frontiers[number], lambda v: self.edges(v, kind).items())
            found = self.moves[number, kind] = (self.number(new), spent, back)
        return found

    def all_vertices(self) -> list[int]:
        """Every vertex that a conversation can be at between two rows."""
        known = 1
        while True:
            for v in range(known):
                self.inserted(v)
                for kind in range(DELETED + 1):
                    self.edges(v, kind)
            if len(self.vertices) == known:
                break
            known = len(self.vertices)
        reached, todo = {0}, [0]
        while todo:
            v = todo.pop()
            new = {t for kind in range(DELETED + 1) for t in self.edges(v, kind)} - reached
            reached |= new
            todo += new
        return sorted(reached)


def merged(frontier, edges) -> tuple[tuple, int, tuple]:
    """Tops (vertex, cost above the least, rank of the audit) after a step, the least cost, and where each came from."""
    best: dict[int, tuple] = {}
    for at, (vertex, cost, rank) in enumerate(frontier):
        for top, (more, letters) in edges(vertex):
            new = (cost + more, rank, letters, at)
            if top not in best or new < best[top]:
                best[top] = new
    least = min(b[0] for b in best.values())
    best = {v: b for v, b in best.items() if b[0] - least <= HOPELESS}
    ranks = {audit: i for i, audit in enumerate(sorted({b[1:3] for b in best.values()}))}
    tops = sorted(best.items())
    return tuple((v, b[0] - least, ranks[b[1:3]]) for v, b in tops), least, tuple((b[3], b[2]) for _, b in tops)


@cache
def parser() -> Parser:
    """One automaton, and one set of vertex numbers, everywhere."""
    made = Parser()
    made.all_vertices()
    return made


def walk(kinds: list[int], start: int) -> list[tuple[int, int, str]]:
    """End vertex, cost and audit of the least edits of these rows, from one vertex to each that they can end in."""
    p = parser()
    frontier, cost, backs = p.starting(start), 0, []
    for kind in kinds:
        frontier, spent, back = p.move(frontier, kind)
        cost += spent
        backs.append(back)
    found = []
    for at, (vertex, more, _) in enumerate(p.frontiers[frontier]):
        letters = []
        for back in reversed(backs):
            at, some = back[at]
            letters.append(some)
        found.append((vertex, cost + more, "".join(reversed(letters))))
    return found


def joined(segments: list[dict[int, list[tuple[int, int, str]]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the tables of its segments: start vertex to (end vertex, cost, audit)."""
    p = parser()
    frontier, cost, backs = ((0, 0, 0),), 0, []
    for table in segments:
        frontier, spent, back = merged(frontier, lambda v, t=table: [(end, (c, a)) for end, c, a in t.get(v, ())])
        cost += spent
        backs.append(back)
    accepted = {}
    for v in range(len(p.vertices)):
        ends = [edit for top, edit in p.inserted(v).items() if p.accepts(top)]
        if ends:
            accepted[v] = min(ends)
    _, spent, back = merged(frontier, lambda v: [(-1, accepted[v])] if v in accepted else [])
    backs.append(back)
    at, parts = 0, []
    for back in reversed(backs):
        at, letters = back[at]
        parts.append(letters)
    return cost + spent, "".join(reversed(parts))


def damaged(rows: DataFrame) -> DataFrame:
    """none, conv, turn, role, text after the damage, and how often the row stands there; by CRC-32 of ``conv_id:turn`` mod 20:
    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20).alias("fate")
    cells = rows.select(conv.alias("conv"), turn.alias("turn"), shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"), fate)
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
    none = F.col("conv").isNull()
    return cells.where("fate <> 0").select(none.alias("none"), F.coalesce("conv", F.lit(0)).alias("conv"), "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _head() -> Column:
    return F.substring("text", 1, 64).alias("head")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


ORDER = ["turn", "role", "head", "digest"]


def marks(rows: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text) in place of the texts: its kind of fault, initial and count."""
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((initial < 0) | (F.col("role") == ""), F.lit(3)).otherwise(initial).cast("long").alias("initial")
    blank, cut = F.col("text").rlike(_BLANK).alias("blank"), F.col("text").rlike(_CUT_OFF).alias("cut")
    own = ["none", "conv", *ORDER, "initial", "blank", "cut"]
    light = rows.select("none", "conv", "turn", "role", _head(), _digest(), initial, blank, cut, "copies")
    light = light.groupBy(*own).agg(F.sum("copies").alias("n"))
    same = ["none", "conv", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    again = light.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    seen = join_by_group(light, again, same, ["turn"], "left")
    later = F.col("first").isNotNull() & (place > F.col("first"))
    return seen.select(*own, "n", F.coalesce(later, F.lit(False)).alias("later"))


SUMMARY = "part long, seq long, blank long, duplicate long, truncated long, illegal long, first long, last long, turns long, low long, high long"
EDITS = "edits array<struct<start:int,end:int,cost:long,audit:string>>"


def segments(marked: DataFrame) -> DataFrame:
    """Counts and edit tables of the runs of rows that a conversation has in each partition of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, current = TaskContext.get().partitionId(), 0, None
        held: list[tuple[np.ndarray, ...]] = []
        whole, count = False, 0
        names = ("none", "conv", "known", "turn", "initial", "blank", "cut", "n", "later")
        for batch in batches:
            cells = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
            begins = np.flatnonzero(starts_of(cells[0].astype(bool), cells[1]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                key = (bool(cells[0][a]), int(cells[1][a]))
                if key != current:
                    if held:
                        yield _segment(current, part, seq, held, whole)
                    whole = current is not None  # the first of a partition may have begun before
                    current, held, count, seq = key, [], 0, seq + 1
                while a < b:
                    c = min(b, a + SEGMENT - count)
                    held.append(tuple(x[a:c] for x in cells[2:]))
                    count, a = count + c - a, c
                    if count == SEGMENT:
                        yield _segment(current, part, seq, held, whole)
                        whole, held, count, seq = False, [], 0, seq + 1
        if held:
            yield _segment(current, part, seq, held, whole)

    known = F.col("turn").isNotNull()
    dealt = marked.repartitionByRange("none", "conv", F.col("turn").asc_nulls_first(), "role", "head", "digest")
    dealt = dealt.sortWithinPartitions("none", "conv", F.col("turn").asc_nulls_first(), "role", "head", "digest")
    rows = dealt.select("none", "conv", known.alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "initial", "blank", "cut", "n", "later")
    return rows.mapInArrow(run, f"none boolean, conv long, {SUMMARY}, {EDITS}")


def _segment(key: tuple[bool, int], part: int, seq: int, held: list[tuple[np.ndarray, ...]], whole: bool) -> pa.RecordBatch:
    known, turn, initial, blank, cut, n, later = (np.concatenate(x) for x in zip(*held, strict=True))
    known, blank, cut, later = (x.astype(bool) for x in (known, blank, cut, later))
    must = blank | later
    kinds = np.where(must, DELETED, initial + np.where(cut, TRUNCATED, 0))
    row = np.repeat(np.arange(len(n)), n)
    kinds = np.where(starts_of(row), kinds[row], DELETED).tolist()  # further copies of a row are duplicates
    duplicates = np.where(blank, 0, n - 1 + later)
    illegal = int((n - 1).sum()) + int((~_LEGAL[initial[:-1], initial[1:]]).sum())
    turns = turn[known]
    low, high = (int(turns[0]), int(turns[-1])) if len(turns) else (None, None)
    counts = [blank @ n, duplicates.sum(), (cut & ~must).sum(), illegal, initial[0], initial[-1], np.count_nonzero(starts_of(turns)), low, high]
    starts = [0] if whole else parser().all_vertices()
    edits = [{"start": s, "end": end, "cost": cost, "audit": audit} for s in starts for end, cost, audit in walk(kinds, s)]
    cells = [key[0], key[1], part, seq, *(None if c is None else int(c) for c in counts), edits]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    types = [pa.bool_(), *[pa.int64()] * 12, kind]
    names = ["none", "conv", *(c.split()[0] for c in SUMMARY.split(", ")), "edits"]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of a conversation while its rows pass by."""

    def __init__(self, none: bool, conv: int) -> None:
        self.conv = None if none else conv
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last = None
        self.tables: list[dict[int, list[tuple[int, int, str]]]] = []
        self.audit, self.cost = None, 0
        self.hash, self.lines, self.at, self.vertex = hashlib.sha256(), 0, 0, 0

    def add(self, s: dict) -> None:
        for c in self.counts:
            self.counts[c] += s[c]
        if self.last is not None:
            self.counts["illegal"] += not _LEGAL[self.last, s["first"]]
        self.last = s["last"]
        if s["low"] is not None:
            self.counts["turns"] -= self.high == s["low"]
            self.low, self.high = (s["low"] if self.low is None else self.low), s["high"]
        table: dict[int, list[tuple[int, int, str]]] = {}
        for e in s["edits"]:
            table.setdefault(e["start"], []).append((e["end"], e["cost"], e["audit"]))
        self.tables.append(table)

    def _line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":" + text.encode())
        self.lines += 1

    def _given(self) -> str:
        """The role that fits next, of those that can be given."""
        symbol = next(s for s in GIVEN if parser().shifted(self.vertex, s))
        self.vertex = parser().shifted(self.vertex, symbol)[0]
        return ROLES[symbol]

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._given(), "")
            self.at += 1

    def _parse(self) -> None:
        if self.audit is None:
            self.cost, self.audit = joined(self.tables)
            self.tables = []

    def text(self, role: str, text: str, copies: int) -> None:
        self._parse()
        for _ in range(copies):
            self._insertions()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.vertex = parser().shifted(self.vertex, role[0])[0]
                self._line(role, text)
            elif edit == "R":
                self._line(self._given(), text)

    def end(self) -> tuple:
        self._parse()
        self._insertions()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        counts = self.counts | {"gaps": gaps, "cost": self.cost}
        return (self.conv, *(counts[c] for c in COUNTS), self.audit, self.hash.hexdigest())


def repair(conversations: DataFrame) -> DataFrame:
    """Per conv_id of the table: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its damaged rows."""
    rows = damaged(conversations)
    conv = F.col("conv_id").cast("long")
    all_of_them = conversations.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    found = cut_lineage(segments(marks(rows)))
    zero = F.lit(0).cast("long")
    texts = rows.select("none", "conv", F.lit(2).alias("step"), "turn", "role", _head(), _digest(), "text", "copies", zero.alias("part"), zero.alias("seq"))
    both = all_of_them.withColumn("step", F.lit(0)).unionByName(found.withColumn("step", F.lit(1)), allowMissingColumns=True)
    both = both.unionByName(texts, allowMissingColumns=True)
    order = ["none", "conv", "step", "part", "seq", F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    dealt = both.repartition("none", "conv").sortWithinPartitions(*order).drop("head", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        types = [pa.int64()] * 7 + [pa.string()] * 2
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    if r["step"] == 0:
                        if now is not None:
                            done.append(now.end())
                        now = _Conversation(r["none"], r["conv"])
                    elif r["step"] == 1:
                        now.add(r)
                    else:
                        now.text(r["role"], r["text"], r["copies"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now is not None:
            cells = zip(([x] for x in now.end()), types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cells], names)

    kinds = ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])
    return dealt.mapInArrow(run, kinds)
