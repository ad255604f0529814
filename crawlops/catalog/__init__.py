"""All named queries."""

from __future__ import annotations

import importlib

MODULES = ["reports", "functions", "joins", "alerts", "streams", "config", "quality", "sqlfunctions", "maintained"]


def load():
    """Registry with every query module imported."""
    for name in MODULES:
        importlib.import_module(f"crawlops.catalog.{name}")
    return importlib.import_module("crawlops.catalog.registry")
