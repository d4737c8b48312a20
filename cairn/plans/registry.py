"""All registered queries over the driver tables with their SQL.

A query module holds QUERIES (name -> function of spark and sf_dir) and SQL (name -> DuckDB text).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["metrics", "joins", "windows", "graphs", "verdicts", "events"]


def _modules():
    return [importlib.import_module(f"cairn.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
