"""All registered queries of the library and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "k1_portfolio_at_risk"


def _modules():
    from tarnlake.plans import basics, governance, history, kpis, landed, portfolio, reports, scaled

    return [kpis, history, governance, basics, landed, reports, scaled, portfolio]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE
    return out
