"""Query catalogue and study drivers."""

import importlib as _importlib

from .registry import CATALOG

for _name in ("sources", "tables", "splits", "neighbours", "scores", "models", "trees", "checks"):
    try:
        _importlib.import_module(f"{__name__}.catalog_{_name}")
    except ModuleNotFoundError as _e:
        if "catalog_" not in str(_e):
            raise

__all__ = ["CATALOG"]
