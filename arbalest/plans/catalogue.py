"""The registered queries: each name has a Spark plan and, where SQL can express it, the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function's name."""

    def add(plan: Plan) -> Plan:
        PLANS[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return add


def load() -> tuple[dict[str, Plan], dict[str, str]]:
    from arbalest.plans import evaluation, features, manifests, registering, reranking, scoring, training  # noqa: F401  they register themselves

    return PLANS, SQL
