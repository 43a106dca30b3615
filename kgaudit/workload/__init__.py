"""Registered queries over the test tables."""

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
