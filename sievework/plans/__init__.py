"""The registered queries of the core and the SQL each is compared with."""

from __future__ import annotations

from . import analysis, built, content, core, crawling, flows, frontier, retrieval, search, serving, upkeep

_MODULES = (core, crawling, frontier, content, built, analysis, search, retrieval, serving, upkeep, flows)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
