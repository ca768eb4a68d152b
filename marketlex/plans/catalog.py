"""All registered queries (``name -> (spark, sf_dir) -> DataFrame``) and
their DuckDB oracles (``name -> SQL``)."""

from __future__ import annotations

import importlib

MODULES = ["q_text", "q_results", "q_scoring", "q_sampling", "q_market", "q_stats", "q_io"]


def _load():
    queries, oracles = {}, {}
    for m in MODULES:
        try:
            mod = importlib.import_module(f"marketlex.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name == f"marketlex.plans.{m}":
                continue
            raise
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
