"""Collects the query modules of this package."""

from __future__ import annotations

import importlib
import pkgutil

from .. import queries as _pkg


def collect() -> tuple[dict, dict]:
    """(queries, SQL counterparts) of every module here that defines QUERIES."""
    found, sql = {}, {}
    for m in sorted(pkgutil.iter_modules(_pkg.__path__), key=lambda m: m.name):
        if m.name == "registry":
            continue
        mod = importlib.import_module(f"{_pkg.__name__}.{m.name}")
        found |= mod.QUERIES
        sql |= mod.ORACLE
    return found, sql
