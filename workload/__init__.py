"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib

from workload.catalog import QUERIES, SQL

MODULES = ["disclosure", "preparation", "rules", "comparison", "closeness", "budgets", "synthetic", "records", "whole_run"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"workload.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
