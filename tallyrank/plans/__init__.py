"""Registered queries: name -> (function of a session and a data folder, DuckDB text or None)."""

from __future__ import annotations

import importlib

MODULES = ("rankings", "series", "detection", "construction", "files")


def registry() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return found
