"""Registered queries of the graph operators and the SQL they are checked against."""

from __future__ import annotations

import importlib

_MODULES = ("reads", "audits", "paths", "search", "vectors", "changes", "tenancy", "streams", "code", "joins", "records")


def _load():
    for m in _MODULES:
        importlib.import_module(f"graphloom.plans.{m}")
    return importlib.import_module("graphloom.plans.registry")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().SQL)
