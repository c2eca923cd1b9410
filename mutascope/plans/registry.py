"""Collects the registered queries and their oracle SQL from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = [
    "mutascope.plans.protein_queries",
    "mutascope.plans.table_queries",
    "mutascope.plans.eval_queries",
    "mutascope.plans.io_queries",
    "mutascope.plans.model_queries",
    "mutascope.plans.boost_queries",
]


def _load():
    qs, sqls = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for k, v in mod.QUERIES.items():
            if k in qs:
                raise ValueError(f"duplicate query name {k}")
            qs[k] = v
        sqls.update(mod.ORACLES)
    return qs, sqls


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
