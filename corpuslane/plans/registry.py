"""Collects the registered queries and their SQL from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("packed", "corpus", "search", "documents", "events", "learning", "more", "structured", "rules", "hybrid")


def _modules():
    return [import_module(f"corpuslane.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query for module in _modules() for key, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _modules() for key, sql in module.ORACLE.items()}
