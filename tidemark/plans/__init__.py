"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("market", "trading", "context", "records", "upkeep", "streams")


def load_registry():
    """Import the query modules once and return name -> query."""
    from tidemark.plans.registry import REGISTRY

    for m in _MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    return REGISTRY
