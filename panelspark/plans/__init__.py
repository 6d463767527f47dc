"""Registered queries over the star-schema tables."""

from __future__ import annotations

import importlib

from panelspark.plans.registry import REGISTRY, Query

MODULES = ("panel", "stations", "sessions", "weather", "raster", "evaluation", "tables", "modelling", "streams")


def catalog() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"panelspark.plans.{module}")
    return dict(REGISTRY)
