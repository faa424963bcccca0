"""Registered queries: one module per area, each naming its Spark job and oracle."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

_AREAS = (
    "poses", "metrics", "meshes", "clouds", "curves", "features", "flows", "tables", "streams", "jobs",
)


def _load() -> None:
    for area in _AREAS:
        importlib.import_module(f"{__name__}.{area}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
