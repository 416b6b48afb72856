"""The query modules of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import leafmill.llm as package


def modules() -> list:
    """Every module of the subpackage that registers queries, by name."""
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.endswith("_queries"))
    return [importlib.import_module(f"{package.__name__}.{name}") for name in names]
