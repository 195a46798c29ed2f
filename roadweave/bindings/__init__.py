"""Queries over the benchmark tables, each with its ANSI SQL twin where one exists."""

from types import ModuleType


def load() -> ModuleType:
    """Import all query groups and return the registry."""
    from roadweave.bindings import columns, files, registry, search, tables  # noqa: F401

    return registry
