"""Policies and registered queries."""

from __future__ import annotations

from importlib import import_module

#: Modules whose import registers their queries.
MODULES = ("detection", "masking", "conversations", "labelled", "interchange", "streams")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from .registry import ORACLE_SQL, QUERIES

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLE_SQL
