"""Registry of every query: operator id -> Spark callable, and its oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "concordia.plans.catalog_agreement",
    "concordia.plans.catalog_quality",
    "concordia.plans.catalog_prep",
    "concordia.plans.catalog_explain",
    "concordia.plans.catalog_io",
    "concordia.plans.catalog_models",
    "concordia.plans.catalog_lime",
    "concordia.plans.catalog_more",
    "concordia.plans.catalog_flow",
]


def _load():
    queries, oracles = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        queries.update(mod.QUERIES)
        oracles.update({k: v for k, v in mod.ORACLES.items() if v})
    return queries, oracles


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
