"""Registered queries: every operator run over the parquet tables, next to the SQL that must agree."""

from __future__ import annotations

from clipgrid.catalog import attention, flows, identity, masks, scoring, sources, text, timeline, work

MODULES = (identity, text, sources, timeline, masks, attention, work, scoring, flows)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.CASES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.CASES.items() if sql}
