"""All queries of the core with their SQL, collected from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["references", "nested", "flows", "graph", "corpus", "quality", "evidence", "events"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        found = getattr(importlib.import_module(f"quern.plans.{module}"), name)
        if twice := out.keys() & found.keys():
            raise ValueError(f"queries defined twice: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
