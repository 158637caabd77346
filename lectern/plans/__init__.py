"""Registered queries with their SQL oracles."""

import importlib
import importlib.util

#: Modules that register queries.
MODULES = ("reader", "events", "tags", "notes", "text", "layout", "state", "extras", "more")


def load() -> tuple[dict, dict]:
    """All queries and oracles of the library."""
    from lectern.plans import registry

    for name in MODULES:
        if importlib.util.find_spec(f"lectern.plans.{name}"):
            importlib.import_module(f"lectern.plans.{name}")
    return registry.QUERIES, registry.ORACLES
