"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "queries_detect",
    "queries_mask",
    "queries_party",
    "queries_functions",
    "queries_tables",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"kuronuri.plans.{name}")
