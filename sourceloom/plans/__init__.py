"""Queries over the given tables."""

from importlib import import_module

MODULES = ["evidence_queries", "scoring_queries", "usage_queries", "state_queries", "retrieval_queries", "lineage_queries", "audit_queries", "source_queries", "stream_queries"]


def all_queries():
    """Every registered query by name."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from .registry import QUERIES
    return QUERIES
