"""All registered queries, imported in survey order."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Registered

# The modules that register queries.
MODULES = (
    "view_queries",
    "feature_queries",
    "pit_queries",
    "metric_queries",
    "market_queries",
    "source_queries",
    "ledger_queries",
    "gate_queries",
    "stream_queries",
)


def all_queries() -> dict[str, Registered]:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return dict(REGISTRY)
