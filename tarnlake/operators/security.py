"""Row filters and masks by role, as views built for one user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN, MANAGER, COLLECTOR, ANALYST, EXECUTIVE = "admin", "manager", "collector", "analyst", "executive"
_SEES = {"phone": {ADMIN, MANAGER, COLLECTOR}, "email": {ADMIN, MANAGER, COLLECTOR}, "ssn": {ADMIN, COLLECTOR}, "dob": {ADMIN, MANAGER, COLLECTOR}}
#: Which layers a role may read.
ACCESS = {ADMIN: {"bronze", "silver", "gold", "kpi"}, MANAGER: {"gold", "kpi"}, COLLECTOR: {"gold"}, ANALYST: {"silver", "gold", "kpi"}, EXECUTIVE: {"kpi"}}


def mask(kind: str, c: Column, role: str) -> Column:
    """A column as a role may see it; roles that are not known see the mask."""
    if role in _SEES[kind]:
        return c
    if kind == "phone":
        return F.regexp_replace(c, r"^.{1,7}", "*******")
    if kind == "email":
        return F.when(c.isNotNull(), F.concat(F.lit("***@"), F.coalesce(F.get(F.split(c, "@"), F.lit(1)), F.lit(""))))
    if kind == "ssn":
        return F.when(c.isNotNull(), F.lit("****"))
    return F.trunc(c, "YEAR").cast("date")


def masked(df: DataFrame, columns: dict[str, str], role: str) -> DataFrame:
    return df.withColumns({c: mask(k, F.col(c), role) for c, k in columns.items()})


def allowed(role: str, layer: str) -> bool:
    return layer in ACCESS.get(role, set())


def row_filter(df: DataFrame, users: DataFrame, user: str, role: str, owner: str, team: str | None = None) -> DataFrame:
    """Rows a user may see: all for admins and analysts, the team's for managers, their own for collectors, none otherwise.

    ``users`` has (username, collector_id, team_name); only the rows of this one user are joined.
    """
    if role in (ADMIN, ANALYST):
        return df
    me = users.where(F.col("username") == user)
    if role == MANAGER and team:
        return df.join(me.select(F.col("team_name").alias("_t")).distinct(), F.col(team) == F.col("_t"), "left_semi")
    if role == COLLECTOR:
        return df.join(me.select(F.col("collector_id").alias("_c")).distinct(), F.col(owner) == F.col("_c"), "left_semi")
    return df.where(F.lit(False))


def propagate(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, hide: list[str] | None = None) -> DataFrame:
    """A fact restricted to the keys of an already filtered dimension, without hidden columns."""
    keys = dim.select(F.col(dim_key).alias("_k")).distinct()
    return fact.join(keys, F.col(fact_key) == F.col("_k"), "left_semi").drop(*(hide or []))
