"""Names of the engine's queries, their plans and the equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "explore_overview"
_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a plan under its function's name, with the SQL that gives the same rows."""

    def keep(plan: Plan) -> Plan:
        _PLANS[plan.__name__] = plan
        if sql:
            _SQL[plan.__name__] = sql
        return plan

    return keep


def queries() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    """The modules register their plans as they are imported."""
    for name in ("browse", "relational", "analysis", "search", "archive", "ledgers", "streams", "lookups", "services", "capture", "pages", "sources", "engine", "forums", "mail", "growth", "meaning"):
        importlib.import_module(f"tidemark.plans.{name}")
