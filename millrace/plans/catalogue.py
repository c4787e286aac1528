"""Every query outside the optional subpackage, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import base

MODULES = ("quality", "vectors", "splits", "questions", "generation", "evaluation")


def _load() -> None:
    for name in MODULES:
        import_module(f"millrace.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
