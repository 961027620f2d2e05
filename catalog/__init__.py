"""The query catalogue: importing it registers every query."""

from importlib import import_module

from .registry import QUERIES

MODULES = ("sources", "audit", "timeline", "quality", "align", "masks", "physics", "metrics",
           "profiles", "windows", "diagnostics", "forecasting", "performance")


def load():
    for name in MODULES:
        try:
            import_module(f"catalog.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"catalog.{name}":
                raise
    return QUERIES
