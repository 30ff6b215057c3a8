"""Named queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from panelspark.plans.registry import ORACLES, QUERIES, Query

MODULES = ["panel_queries", "event_queries", "network_queries", "stats_queries", "sampling_queries", "model_queries", "effect_queries"]


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"panelspark.plans.{m}")
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
