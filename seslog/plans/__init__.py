"""Query plans over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["interval_queries", "catalog_queries", "time_queries", "conversation_queries", "document_queries", "record_queries", "log_queries"]


def load_queries():
    """Import every query module and return (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"seslog.plans.{name}")
    from seslog.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
