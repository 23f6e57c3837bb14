"""Registered queries: each binds operators to tables and, where SQL can say it, states the SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "scans", "projections", "joins", "aggregates", "dose", "windows",
    "quality", "spatial", "onset", "rules", "labelling", "splits", "sets", "learning",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"wellspring.plans.{module}")
