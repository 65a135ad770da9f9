from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipgrid.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def cheapest(rows):
    """Least (cost, audit) from the back: rows are (initial, must go, truncated); states: nothing yet, after s, u, a."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ""))
        if inserted < 3:
            for role in "ua":
                if (state, role) in after:
                    cost, audit, made = best(i, after[state, role], inserted + 1)
                    found.append((cost + 5, "I" + audit, role + made))
        if i < len(rows):
            initial, must, cut = rows[i]
            cost, audit, made = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, "-" + made))
            for letter, role, own in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                if not must and (state, role) in after:
                    cost, audit, made = best(i + 1, after[state, role], 0)
                    found.append((cost + own + 5 * cut, letter + audit, role + made))
        return min(found, default=(1 << 40, "", ""))

    for i in range(len(rows), 0, -1):  # no deep recursion
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def brute(table):
    """The contract, row by row, from the text of it."""
    found = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=str):
            role, text = role if role is not None else " ", text if text is not None else " "
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            words = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, made = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        lines, left, names = [], iter(rows), {"u": "user", "a": "assistant"}
        for letter, role in zip(audit, made, strict=True):
            row = next(left) if letter != "I" else None
            if letter != "D":
                lines.append(f"{row[1] if letter == 'K' else names[role]}:{row[2] if row else ''}")
        turns = {r[0] for r in rows} - {None}
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def repaired(spark, table, schema=SCHEMA):
    found = turn_repair.repair(spark.createDataFrame(table, schema).repartition(3)).collect()
    assert len(found) == len({r.conv_id for r in found})
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[c] for c in names) for r in found}


def conversations(seed, count=60, most=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Go on!", "a. b", "\x0b", "é", "Well. ", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "User"]
    return [(c, rng.choice([t, t, t + 3, None]) if seed % 2 else t, rng.choice(roles), rng.choice(texts)) for c in range(count) for t in range(rng.randrange(most))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=9), st.lists(st.integers(0, 9), max_size=3))
def test_segments_agree_with_the_search_from_the_back(kinds, cuts):
    rows = [("suat"[k % 4], k == 8, 4 <= k < 8) for k in kinds]
    bounds = sorted({0, len(kinds), *(min(c, len(kinds)) for c in cuts)})
    tables = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        starts = [0] if a == 0 else turn_repair.parser().all_vertices()
        tables.append({s: turn_repair.walk(kinds[a:b], s) for s in starts})
    assert turn_repair.joined(tables) == cheapest(rows)[:2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    table = conversations(seed) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi.")]
    assert repaired(spark, table) == brute(table)


def test_one_long_conversation_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT", 16)
    rng = random.Random(9)
    table = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"Row {t}.", ""])) for t in range(700)]
    table += [(5, None, "user", f"{i}.") for i in range(40)] + [(5, 3, "user", "Again and again.")] * 50 + conversations(4, 10)
    assert repaired(spark, table) == brute(table)


def test_long_texts_and_clashing_columns(spark):
    table = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "word " * 300_000 + "!"), (2, 0, "user", "x" * 100 + "1."), (2, 0, "user", "x" * 100 + "2.")]
    wide = [(*r, "x", True, 7, 1, 2) for r in table]
    found = repaired(spark, wide, SCHEMA + ", head string, none boolean, conv long, part long, n long")
    assert found == brute(table)


def test_rows_that_are_all_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}
