"""Registered queries over the given tables, each with its SQL where one exists."""

from tidepanel.catalog.base import ORACLES, QUERIES


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util

    for mod in ("growth", "cleaning", "frequency", "joining", "transforming",
                "properties", "factors", "sourcing"):
        if importlib.util.find_spec(f"tidepanel.catalog.{mod}"):
            importlib.import_module(f"tidepanel.catalog.{mod}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
