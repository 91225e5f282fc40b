"""Joins and windows over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pit_join(facts: DataFrame, versions: DataFrame, fact_key: str, version_key: str, at: str, start: str = "effective_start", end: str = "effective_end", how: str = "inner") -> DataFrame:
    """The version in force at each fact's time, by the half-open interval start <= at < end.

    An equi join on the key with the interval as a residual: a key's versions are few, so it stays one shuffle a side.
    """
    on = (facts[fact_key] == versions[version_key]) & (facts[at] >= versions[start]) & (facts[at] < versions[end])
    return facts.join(versions, on, how)


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, take: list[str], tiebreak: list[str] | None = None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (nulls where there is none).

    Both sides go through one union and one window, so a key's rows are sorted once and never multiplied.
    Among right rows of one time the last by ``tiebreak`` is taken.
    """
    lcols = left.columns
    kind = dict(left.dtypes)[left_ts]
    l_ = left.select(*key, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    r_ = right.select(*key, F.col(right_ts).cast(kind).alias("_ts"), F.lit(0).alias("_side"), F.struct(*take).alias("_r"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tiebreak or [])])
    w = Window.partitionBy(*key).orderBy("_ts", "_side", *[f"_t{i}" for i in range(len(tiebreak or []))]).rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_l.*", *[F.col("_m")[c].alias(prefix + c) for c in take])


def asof_rank(left: DataFrame, right: DataFrame, key: list[str], left_id: list[str], left_ts: str, right_ts: str, take: list[str], tiebreak: list[str], prefix: str = "asof_") -> DataFrame:
    """The same by an inequality join and ``max_by``; for small sides only, as a key's rows multiply."""
    r_ = right.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(right_ts).alias("_rts"), *[F.col(c).alias(f"_r_{c}") for c in dict.fromkeys([*take, *tiebreak])])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key]) & (F.col("_rts") <= F.col(left_ts))
    best = F.max_by(F.struct(*[F.col(f"_r_{c}").alias(c) for c in take]), F.struct("_rts", *[f"_r_{c}" for c in tiebreak]))
    g = left.join(r_, on, "left").groupBy(*left_id).agg(best.alias("_m"))
    return left.join(g, left_id).select(*left.columns, *[F.col("_m")[c].alias(prefix + c) for c in take])


def lag_flags(snapshots: DataFrame, key: str, day: str, bucket: str = "bucket_index") -> DataFrame:
    """prior bucket, cure (fell to 0) and roll (rose by any step) of each day against the day before it.

    With no earlier day: cure is null at bucket 0 and false otherwise, roll is false.
    """
    prior = F.lag(bucket).over(Window.partitionBy(key).orderBy(day))
    d = snapshots.withColumn("prior_bucket", prior)
    cure = (F.col(bucket) == 0) & (F.col("prior_bucket") > 0)
    roll = F.coalesce(F.col(bucket) > F.col("prior_bucket"), F.lit(False))
    return d.withColumn("cure_flag", cure).withColumn("roll_flag", roll)


def trailing_average(df: DataFrame, value: Column, day: str, days: int, name: str, partition: list[str] | None = None) -> DataFrame:
    """Average over the ``days`` before each date and the date itself, by calendar distance and not by rows."""
    w = Window.partitionBy(*(partition or [])).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, 0)
    return df.withColumn(name, F.avg(value).over(w))


def moving_average(df: DataFrame, value: Column, day: str, rows: int, name: str, partition: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*(partition or [])).orderBy(day).rowsBetween(1 - rows, 0)))


def shifted(df: DataFrame, day: str, columns: list[str], by: Column, suffix: str) -> DataFrame:
    """Each date beside the columns of another (``by``: that date's expression over ``day``); a missing date gives nulls."""
    other = df.select(F.col(day).alias("_d"), *[F.col(c).alias(c + suffix) for c in columns])
    return df.withColumn("_want", by).join(other, F.col("_want") == F.col("_d"), "left").drop("_want", "_d")
