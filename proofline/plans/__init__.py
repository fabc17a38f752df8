"""Query bindings: each operator over the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("tracks", "integrity", "reviews", "motion", "positions", "scoring", "texts", "jobs", "files")

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found.update(import_module(f"proofline.plans.{family}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(import_module(f"proofline.plans.{family}").ORACLE)
    return found
