"""Registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name != "registry":
            importlib.import_module(f"{__name__}.{module.name}")
