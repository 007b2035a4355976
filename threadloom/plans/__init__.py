"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def load_all():
    """Import every ``*_plans`` module and return (queries, oracles)."""
    for found in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if found.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{found.name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
