"""Registered queries of the core operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("hierarchy", "lookup", "graph", "search", "text", "web", "retrieval", "store", "usage", "extraction", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"sparrowdex.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"sparrowdex.plans.{name}").SQL
    return found
