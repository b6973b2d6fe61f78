"""Registered queries by family; every family module has QUERIES and SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["q_history", "q_labels", "q_contest", "q_metrics", "q_backtest", "q_quality", "q_integrate", "q_columns", "q_search", "q_models", "q_ledger"]


def _modules():
    return [importlib.import_module(f"pitpanel.plans.{n}") for n in FAMILIES]


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}


def flagship(spark, sf_dir):
    return queries()["hs3_prior_totals_wide"](spark, sf_dir)
