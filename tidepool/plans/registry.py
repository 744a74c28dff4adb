"""All named queries: name -> (spark callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = (
    "tidepool.plans.q_search",
    "tidepool.plans.q_ingest",
    "tidepool.plans.q_relational",
    "tidepool.plans.q_metrics",
    "tidepool.plans.q_index",
    "tidepool.plans.q_stream",
    "tidepool.plans.q_growing",
    "tidepool.plans.q_live",
)


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for k, v in mod.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query name {k}")
            out[k] = v
    return out
