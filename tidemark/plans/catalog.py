"""All queries of this package by name, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retention", "store", "diffing", "listing", "tree", "series", "tapes", "content", "text", "flows", "endpoints", "lists", "extensions")


def _gathered(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(import_module(f"{__package__}.{name}"), attribute)
        if twice := out.keys() & found.keys():
            raise ValueError(f"{name}: registered twice: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, for the queries that SQL can express."""
    return _gathered("ORACLE")
