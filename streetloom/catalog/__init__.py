"""Every operator as a runnable query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from streetloom.plans.demo import World, complete_sql
from streetloom.session import ship_package


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    build: Callable[[World], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}
_PARTS = ["elements", "rules", "selection", "datasets", "history", "people", "roads", "transit", "timetable",
          "drawing", "live", "files"]


def query(name: str, covers: str, oracle: str | None = None):
    """Register a query. ``covers`` names the inventory rows, ``oracle`` is its SQL (derived tables are added)."""
    def add(fn: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(name, covers, fn, oracle)
        return fn
    return add


def load_all() -> dict[str, Entry]:
    for part in _PARTS:
        try:
            importlib.import_module(f"streetloom.catalog.{part}")
        except ModuleNotFoundError as e:
            if e.name != f"streetloom.catalog.{part}":
                raise
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return entry.build(World(spark, sf_dir))
        return run
    return {name: runner(e) for name, e in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: complete_sql(e.oracle) for name, e in load_all().items() if e.oracle}
