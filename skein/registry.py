"""Every core query by name, with its SQL."""

from __future__ import annotations

from .plans import context_plans, feedback_plans, history_plans, more_plans, pipeline_plans, problems, scalar_plans, search_plans

_MODULES = [problems, scalar_plans, history_plans, search_plans, feedback_plans, more_plans, context_plans, pipeline_plans]


def core_queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def core_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
