"""Shared inputs of the plan modules: the test tables and the portfolio analogues built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import money
from tarnlake.operators.temporal import lag_flags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily grid of users: bucket (errors that day, 4 at most) and balance (sum of values)."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("snapshot_date"), "event_type", "value")
    span = e.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    # One row of bounds beside each user, then the days of the span: no product of two large sides.
    grid = e.select("user_id").distinct().join(F.broadcast(span), how="cross").select("user_id", F.explode(F.sequence("lo", "hi")).alias("snapshot_date"))
    day = e.groupBy("user_id", "snapshot_date").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(money(F.col("value"))).alias("balance"))
    zero = F.lit(0).cast("decimal(18,2)")
    return grid.join(day, ["user_id", "snapshot_date"], "left").select("user_id", "snapshot_date", F.least(F.lit(4), F.coalesce("errors", F.lit(0))).cast("int").alias("bucket_index"), F.coalesce(F.col("balance").cast("decimal(18,2)"), zero).alias("balance"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag_flags(snapshots(spark, sf_dir), "user_id", "snapshot_date")


SNAP = """
e as (select user_id, ts::date as snapshot_date, count(*) filter (event_type = 'error') as errors, sum(cast(value as decimal(18,2))) as balance from events group by 1, 2),
grid as (select u.user_id, d.snapshot_date from (select distinct user_id from events) u, (select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day))::date as snapshot_date) d),
snap as (select g.user_id, g.snapshot_date, least(4, coalesce(errors, 0))::int as bucket_index, coalesce(balance, 0)::decimal(18,2) as balance from grid g left join e using (user_id, snapshot_date)),
lagged as (select *, lag(bucket_index) over (partition by user_id order by snapshot_date) as prior_bucket from snap),
flags as (select *, bucket_index = 0 and prior_bucket > 0 as cure_flag, coalesce(bucket_index > prior_bucket, false) as roll_flag from lagged)
"""


def promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as promises: kept above a value; the contact is the last click before."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value", F.when(F.col("value") >= 60, "Kept").when(F.col("value") >= 30, "Partial").otherwise("Broken").alias("ptp_status"))


PTP = "ptp as (select event_id, user_id, ts, value, case when value >= 60 then 'Kept' when value >= 30 then 'Partial' else 'Broken' end as ptp_status from events where event_type = 'purchase')"


def priority_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change log of each customer's tracked attribute."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")


#: Versions of each customer's priority, half open; of one day's orders the last key holds.
VERSIONS = """
lastday as (select * from (select o_custkey, o_orderdate, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) as rn from orders) where rn = 1),
marked as (select *, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate) as before, row_number() over (partition by o_custkey order by o_orderdate) as k from lastday),
versions as (select o_custkey, o_orderpriority, o_orderdate as effective_start, coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate), timestamp '9999-12-31') as effective_end from marked where k = 1 or before is distinct from o_orderpriority)
"""
latest_first = lambda *c: [F.col(x).desc() for x in c]
by = Window.partitionBy
