"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_split", "q_mainbody", "q_neardup", "q_knn", "q_leak", "q_mix", "q_subjects")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"sparrowdex.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"sparrowdex.llm.{name}"), "SQL", {})
    return found
