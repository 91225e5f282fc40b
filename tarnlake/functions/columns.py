"""Column functions of the lending domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delinquency buckets in order.
BUCKETS = ("Current", "1-29", "30-59", "60-89", "90+", "Charged-off", "Settled")


def bucket_label(bucket: Column) -> Column:
    labels = F.create_map(*[x for i, b in enumerate(BUCKETS) for x in (F.lit(i), F.lit(b))])
    return F.coalesce(labels[bucket.cast("int")], F.lit("Unknown"))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def total(c: Column) -> Column:
    """A sum that does not depend on order."""
    return F.sum(money(c)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def days_between(a: Column, b: Column) -> Column:
    """Calendar boundaries from a to b."""
    return F.datediff(F.to_date(b), F.to_date(a))


def band(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    """The first band with low <= value <= high; values beyond either end take the first or last band."""
    c = F.when(value < bands[0][1], bands[0][0])
    for name, low, high in bands:
        c = c.when((value >= low) & (value <= high), name)
    return c.when(value > bands[-1][2], bands[-1][0])


def rag(value: Column, red: float, amber: float) -> Column:
    return F.when(value >= red, "Red").when(value >= amber, "Amber").when(value.isNotNull(), "Green")


def instalment(principal: Column, yearly_rate: Column, months: Column) -> Column:
    """The level payment of an amortised loan; without interest, the even share."""
    r = yearly_rate / 12
    return F.when(r == 0, principal / months).otherwise(principal * r / (1 - F.pow(1 + r, -months)))


def minimum_payment(balance: Column, share: float = 0.03, least: float = 25.0) -> Column:
    """A revolving account's minimum: a share of the balance, at least ``least``, never more than is owed."""
    return F.least(balance, F.greatest(balance * share, F.lit(least)))


def parse_details(c: Column) -> Column:
    """``k=v;k=v`` as a map."""
    return F.call_function("str_to_map", c, F.lit(";"), F.lit("="))


def stable_share(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone, however rows are partitioned."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
