"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import audit_plans, layer_plans, ledger_plans, review_plans, stream_plans, tag_plans, text_plans

PLANS = (text_plans, ledger_plans, tag_plans, layer_plans, audit_plans, stream_plans, review_plans)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return text_plans.pii_map(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
