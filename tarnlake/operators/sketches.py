"""Distinct counts and quantiles by sketches that are stored by day and merged for any span.

A day's rows are read once. A week, a month or a year, with or without some of the keys, is a merge of stored
states, whose size does not depend on how many rows they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count, and the k of a quantile sketch.
REGISTERS, K = 14, 400
#: What the two are off by, at two standard errors: of the count, and of the rank.
DISTINCT_ERROR, RANK_ERROR = 2 * 0.8326 / 2 ** (REGISTERS / 2), 2 * 2.3 / K**0.9


def daily(df: DataFrame, day: str, keys: list[str], distinct: list[str], values: list[str]) -> DataFrame:
    """One row for each day and key: n, hll_<column> and kll_<column>. Nulls are not counted; a column without a value has an empty state."""
    hll = [F.hll_sketch_agg(F.col(c).cast("string"), REGISTERS).alias(f"hll_{c}") for c in distinct]
    kll = [F.expr(f"kll_sketch_agg_double(cast(`{c}` as double), {K})").alias(f"kll_{c}") for c in values]
    return df.groupBy(F.to_date(day).alias("day"), *keys).agg(F.count("*").alias("n"), *hll, *kll)


def roll_up(states: DataFrame, unit: str | None, keys: list[str]) -> DataFrame:
    """States of a unit (week, month, quarter, year, or None for all days) and of some of the keys, from daily ones or other roll-ups alone."""
    by = [F.to_date(F.date_trunc(unit, "day")).alias("day")] if unit else []
    hll = [F.hll_union_agg(c).alias(c) for c in states.columns if c.startswith("hll_")]
    kll = [F.expr(f"kll_merge_agg_double(`{c}`)").alias(c) for c in states.columns if c.startswith("kll_")]
    return states.groupBy(*by, *keys).agg(F.sum("n").alias("n"), *hll, *kll)


def read(states: DataFrame, quantiles: list[float]) -> DataFrame:
    """distinct_<column>, and for each quantile <column>_q<percent>."""
    keep = [c for c in states.columns if not c.startswith(("hll_", "kll_"))]
    out = [F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in states.columns if c.startswith("hll_")]
    for c in states.columns:
        if c.startswith("kll_"):
            out += [F.expr(f"case when kll_sketch_get_n_double(`{c}`) > 0 then kll_sketch_get_quantile_double(`{c}`, {q}D) end").alias(f"{c[4:]}_q{round(q * 100)}") for q in quantiles]
    return states.select(*keep, *out)
