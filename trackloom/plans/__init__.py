"""Example queries: each operator applied to the given tables."""

from __future__ import annotations

import importlib

from trackloom.plans.registry import REGISTRY, runner

MODULES = ["clock", "signals", "structure", "resolve", "text", "rules", "lineage", "compare",
           "files", "streams"]


def all_queries():
    """(queries, oracle SQL), both keyed by query name."""
    for module in MODULES:
        importlib.import_module(f"trackloom.plans.{module}_queries")
    queries = {name: runner(fn) for name, (fn, _) in REGISTRY.items()}
    return queries, {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
