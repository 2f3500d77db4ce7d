"""All registered queries with their SQL checks."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every ``*_queries`` module once and return (queries, checks)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
        importlib.import_module(f"{__name__}.{module}")
    from .common import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
