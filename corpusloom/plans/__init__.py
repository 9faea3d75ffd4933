"""Registered queries and the SQL that checks them."""

from importlib import import_module

MODULES = ("intake_queries", "parse_queries", "search_queries", "evaluate_queries", "sink_queries", "flagship")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
