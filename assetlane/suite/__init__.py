"""Fixture views and registered queries."""

from __future__ import annotations

import importlib

_MODULES = ["files", "sweeps", "rasters", "documents", "settings", "runs", "events"]


def load_cases():
    """Every registered query by name."""
    from assetlane.suite.registry import CASES

    for module in _MODULES:
        try:
            importlib.import_module(f"assetlane.suite.{module}")
        except ModuleNotFoundError as missing:
            if not str(missing.name).startswith("assetlane.suite"):
                raise
    return CASES
