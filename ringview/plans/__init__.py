"""Registered queries of the view engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES: tuple[str, ...] = ("tpch", "features", "views", "sources", "changes", "molecules", "streams")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: f for m in _MODULES for k, f in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
