"""Registers the queries of this subpackage: name -> query and, where SQL can say it, check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "op1_query", "op2_query", "op3_query", "op4_query", "op5_query", "op6_query", "op7_query",
    "op8_query", "op9_query", "op10_query", "op11_query", "op12_query", "op13_query",
    "pipeline_query",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"kuronuri.llm.{name}")
