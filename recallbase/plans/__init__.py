"""Registered queries, a module per family of operators."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("search_queries", "ops_queries", "life_queries", "rule_queries", "source_queries", "stream_queries", "scalar_queries", "state_queries", "research_queries", "decision_queries", "corpus_queries")


def load():
    """The registry with all modules of queries imported."""
    from recallbase.plans import registry

    for name in MODULES:
        importlib.import_module(f"recallbase.plans.{name}")
    return registry
