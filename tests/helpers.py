"""Shared by the tests of this folder."""

from __future__ import annotations


def rows(df, *order):
    """Rows as tuples, sorted, for comparison."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


def pixels(df, *keys):
    """Pixels of runs as a dict from key to set of (y, x)."""
    result: dict = {}
    for r in df.collect():
        cell = result.setdefault(tuple(r[k] for k in keys), set())
        for x in range(r["x0"], r["x1"]):
            assert (r["y"], x) not in cell, "runs overlap"
            cell.add((r["y"], x))
    return result
