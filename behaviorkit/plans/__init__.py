"""Registered queries (one per operator family) and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ("cdr", "assembly", "text", "decoding", "io", "models")


def _load():
    for m in _MODULES:
        importlib.import_module(f"behaviorkit.plans.{m}")


def all_queries():
    _load()
    from behaviorkit.plans.registry import QUERIES
    return dict(QUERIES)


def all_oracle_sql():
    _load()
    from behaviorkit.plans.registry import ORACLE
    return dict(ORACLE)
