"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_sources", "q_columns", "q_rows", "q_aggregates", "q_windows", "q_spatial", "q_graph", "q_models", "q_streaming")


def load():
    """Import every query module; returns (queries, SQL twins)."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
