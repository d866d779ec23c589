"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("records", "splitting", "retrieval", "stored", "answers", "serving")


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"workload.{module}"), name))
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
