"""Histories, merges and temporal joins (DML, J, W, ST analogues) on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import total
from tarnlake.operators import merge, temporal
from tarnlake.plans.common import VERSIONS, priority_log, promises, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _versions(spark, sf_dir):
    v = merge.scd2_history(priority_log(spark, sf_dir), ["o_custkey"], "o_orderdate", ["o_orderpriority"], ["o_orderkey"])
    return v.select("o_custkey", "o_orderpriority", "effective_start", "effective_end", "is_current")


@query(f"with {VERSIONS} select *, effective_end = timestamp '9999-12-31' as is_current from versions")
def dml4_scd2_from_log(spark, sf_dir):
    return _versions(spark, sf_dir)


@query("with v as (select * from (select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) as rn from orders) where rn = 1) select o_custkey, o_orderpriority, o_orderdate as effective_start, coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate), timestamp '9999-12-31') as effective_end from v")
def dml5_scd2_every_row(spark, sf_dir):
    v = merge.scd2_history(priority_log(spark, sf_dir), ["o_custkey"], "o_orderdate", ["o_orderpriority"], ["o_orderkey"], every_row=True)
    return v.select("o_custkey", "o_orderpriority", "effective_start", "effective_end")


@query(f"with {VERSIONS} select *, effective_end = timestamp '9999-12-31' as is_current from versions")
def dml3_scd2_incremental(spark, sf_dir):
    """Three batches applied one after the other, the last one twice: the same versions as the whole log gives."""
    log = priority_log(spark, sf_dir)
    cut = lambda a, b: log.where((F.col("o_orderdate") >= F.lit(a).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(b).cast("timestamp_ntz")))
    key = (["o_custkey"], "o_orderdate", ["o_orderpriority"], ["o_orderkey"])
    state = merge.scd2_history(cut("1900-01-01", "1997-01-01"), *key)
    for batch in (cut("1997-01-01", "1999-06-01"), cut("1999-06-01", "2100-01-01"), cut("1999-06-01", "2100-01-01")):
        state = merge.scd2_apply(state, batch, *key)
    return state.select("o_custkey", "o_orderpriority", "effective_start", "effective_end", "is_current")


@query("""
with ev as (select user_id, ts, event_type from events),
signup as (select user_id, min(ts) as ts from ev group by 1),
points as (select user_id, ts from signup union select user_id, ts from ev where event_type in ('error', 'purchase')),
v as (select p.user_id, p.ts as effective_start, coalesce(bool_or(e.event_type = 'error'), false) as error_flag, coalesce(bool_or(e.event_type = 'purchase'), false) as buyer_flag, min(case when e.event_type = 'error' then e.ts end) as first_error
  from points p left join (select * from ev where event_type in ('error', 'purchase')) e on e.user_id = p.user_id and e.ts <= p.ts group by 1, 2)
select *, coalesce(lead(effective_start) over (partition by user_id order by effective_start), timestamp '9999-12-31') as effective_end from v""")
def dml6_scd2_from_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    first = e.groupBy("user_id").agg(F.min("ts").alias("start"))
    own = e.where(F.col("event_type").isin("error", "purchase"))
    is_error = F.col("event_type") == "error"
    return merge.scd2_events(first, own, "user_id", "start", "ts", {"error_flag": is_error, "buyer_flag": F.col("event_type") == "purchase"}, {"first_error": is_error}).drop("is_current")


_DEDUP = "select * from (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn from lineitem) where rn = 1"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return merge.latest(li, ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")])


@query(f"select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from ({_DEDUP})")
def w1_latest_wins(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query(f"""
with d as ({_DEDUP}), s as (select * from d where l_orderkey % 3 <> 0), c as (select l_orderkey, l_linenumber, l_partkey, l_quantity + 1 as l_quantity, l_extendedprice * 2 as l_extendedprice from d where l_orderkey % 2 = 0)
select coalesce(s.l_orderkey, c.l_orderkey) as l_orderkey, coalesce(s.l_linenumber, c.l_linenumber) as l_linenumber, case when s.l_orderkey is null then c.l_partkey else s.l_partkey end as l_partkey, coalesce(c.l_quantity, s.l_quantity) as l_quantity, case when s.l_orderkey is null then c.l_extendedprice else s.l_extendedprice end as l_extendedprice
from s full join c on s.l_orderkey = c.l_orderkey and s.l_linenumber = c.l_linenumber""")
def dml7_upsert_partial(spark, sf_dir):
    """New keys are inserted whole; known ones take the quantity alone."""
    d = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = d.where("l_orderkey % 3 <> 0")
    c = d.where("l_orderkey % 2 = 0").withColumns({"l_quantity": F.col("l_quantity") + 1, "l_extendedprice": F.col("l_extendedprice") * 2})
    return merge.upsert(s, c, ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query("with s as (select event_id, user_id, event_type from events where event_id % 2 = 0), c as (select event_id, user_id, 'changed' as event_type from events where event_id % 3 = 0) select * from s union all select * from c where event_id not in (select event_id from s)")
def dml9_insert_only(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return merge.insert_only(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("event_type", F.lit("changed")), ["event_id"])


@query("""
with a as (select c_custkey, c_mktsegment, c_acctbal from customer), b as (select c_custkey, case when c_custkey % 10 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment, c_acctbal from customer where c_custkey % 7 <> 0)
select a.*, timestamp '2025-01-01' as valid_from, case when b.c_mktsegment is distinct from a.c_mktsegment and b.c_custkey is not null then timestamp '2025-01-02' end as valid_to from a left join b using (c_custkey)
union all select b.*, timestamp '2025-01-02', null from b join a using (c_custkey) where a.c_mktsegment is distinct from b.c_mktsegment""")
def dml12_snapshot_check(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    b = a.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    one = merge.snapshot_check(None, a, ["c_custkey"], ["c_mktsegment"], at("2025-01-01"))
    return merge.snapshot_check(one, b, ["c_custkey"], ["c_mktsegment"], at("2025-01-02"))


@query("select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderdate <= timestamp '1998-12-31') where rn = 1")
def dml13_current_as_of(spark, sf_dir):
    return merge.current_as_of(priority_log(spark, sf_dir), ["o_custkey"], "o_orderdate", F.lit("1998-12-31").cast("timestamp_ntz"), ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("select n_nationkey, n_name, row_number() over (order by n_name, n_nationkey) + 100 as sk from nation")
def dml14_sequence_key(spark, sf_dir):
    return merge.sequence_key(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 100)


@query("select o_orderkey, md5(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus)) as sk from orders")
def f12_hash_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", merge.hash_key("o_orderkey", "o_custkey", "o_orderstatus"))


@query("select c_custkey, c_custkey % 9 = 0 as is_deleted from customer")
def dml17_reconcile_deletes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return merge.reconcile_deletes(c, c.where("c_custkey % 9 <> 0"), ["c_custkey"])


@query(f"with {VERSIONS} select l_orderkey, l_linenumber, l_extendedprice, v.o_orderpriority, v.effective_start from lineitem join (select o_orderkey, o_custkey, o_orderdate from orders) o on o_orderkey = l_orderkey join versions v on v.o_custkey = o.o_custkey and o.o_orderdate >= v.effective_start and o.o_orderdate < v.effective_end")
def j3_point_in_time(spark, sf_dir):
    """Lines with the customer version in force at their order's date."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderdate")
    v = _versions(spark, sf_dir)
    return temporal.pit_join(li.join(o, li.l_orderkey == o.o_orderkey), v, "cust", "o_custkey", "o_orderdate").select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderpriority", "effective_start")


@query(f"with {VERSIONS} select e.event_id, e.user_id, v.o_orderpriority from events e left join versions v on v.o_custkey = e.user_id and e.ts - interval 26 years >= v.effective_start and e.ts - interval 26 years < v.effective_end")
def j4_point_in_time_left(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("ts - interval 26 years").alias("at"))
    return temporal.pit_join(e, _versions(spark, sf_dir), "user_id", "o_custkey", "at", how="left").select("event_id", "user_id", "o_orderpriority")


@query("select p.event_id, p.user_id, c.event_id as asof_event_id, c.value as asof_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts")
def j5_asof(spark, sf_dir):
    p = promises(spark, sf_dir).select("event_id", "user_id", "ts")
    c = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    return temporal.asof_join(p, c, ["user_id"], "ts", "ts", ["event_id", "value"], ["event_id"]).drop("ts")


@query("select p.event_id, p.user_id, c.event_id as asof_event_id from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'error') c on p.user_id = c.user_id and p.ts >= c.ts")
def j6_asof_by_rank(spark, sf_dir):
    p = promises(spark, sf_dir).select("event_id", "user_id", "ts")
    c = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return temporal.asof_rank(p, c, ["user_id"], ["event_id"], "ts", "ts", ["event_id"], ["event_id"]).drop("ts")


@query("select s_suppkey, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j1_j2_dimension_joins(spark, sf_dir):
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("select event_type, case event_type when 'click' then 'CALL_OUT' when 'view' then 'WEB' when 'purchase' then 'APP' else 'OTHER' end as channel, count(*) as n from events group by 1, 2")
def j7_mapped_key(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for x in ("click", "CALL_OUT", "view", "WEB", "purchase", "APP")])
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(m[F.col("event_type")], F.lit("OTHER")).alias("channel")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def j8_anti_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")



@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def j10_semi_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("with r as (select event_id, user_id, event_id - 5 as original_id from events where event_type = 'error') select r.event_id, r.original_id from r left join events o on o.event_id = r.original_id and o.event_type = 'purchase' where o.event_id is null")
def j11_orphan_reversals(spark, sf_dir):
    """Reversals (errors) whose original (five ids before) is no purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    r = e.where("event_type = 'error'").select("event_id", (F.col("event_id") - 5).alias("original_id"))
    o = e.where("event_type = 'purchase'").select(F.col("event_id").alias("o_id"))
    return r.join(o, r.original_id == o.o_id, "left_anti")


@query("select a.full_date is not null as has_order, count(*) as n from lineitem join orders on o_orderkey = l_orderkey left join (select distinct o_orderdate::date as full_date from orders) a on a.full_date = o_orderdate::date left join (select distinct o_orderdate::date as full_date from orders) b on b.full_date = l_shipdate::date group by 1")
def j13_role_playing_dates(spark, sf_dir):
    from tarnlake.sources.landing import calendar

    d = F.broadcast(calendar(spark, "1990-01-01", "2030-12-31").select("full_date"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(d.alias("a"), F.col("ordered") == F.col("a.full_date"), "left").join(d.alias("b"), F.col("ship") == F.col("b.full_date"), "left")
    return j.groupBy(F.col("a.full_date").isNotNull().alias("has_order")).agg(F.count("*").alias("n"))


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct o_custkey) as customers from lineitem join orders on o_orderkey = l_orderkey group by 1")
def j14_bridge(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("o_custkey").alias("customers"))


@query("select user_id, ts::date as day, count(*) as n, row_number() over (partition by user_id order by count(*) desc, ts::date) as rank from events group by 1, 2 qualify rank <= 3")
def w2_top_days(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "day"))
    return g.withColumn("rank", r.cast("long")).where("rank <= 3")


@query("with d as (select user_id, ts::date as day, cast(sum(cast(value as decimal(18,2))) as double) as v from events group by 1, 2) select user_id, day, round(avg(v) over (partition by user_id order by day range between interval 7 days preceding and current row), 6) as v_7d from d")
def w7_trailing_average(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(total(F.col("value")).alias("v"))
    return temporal.trailing_average(d, F.col("v"), "day", 7, "m", ["user_id"]).select("user_id", "day", F.round("m", 6).alias("v_7d"))


@query("select event_id, user_id, 'click' as source_system from events where event_type = 'click' union all select event_id, user_id, 'view' from events where event_type = 'view'")
def s1_union_conformed(spark, sf_dir):
    """Two sources, one with a renamed column, as one."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("user_ref_id"))
    b = e.where("event_type = 'view'").select("event_id", "user_id")
    return a.withColumnRenamed("user_ref_id", "user_id").withColumn("source_system", F.lit("click")).unionByName(b.withColumn("source_system", F.lit("view")))


@query("select user_id, ts::date as d from events where event_type = 'click' union select user_id, ts::date from events where event_type = 'error'")
def s2_union_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    return e.where(F.col("event_type").isin("click", "error")).select("user_id", "d").distinct()


@query("select s_suppkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue from supplier join lineitem on l_suppkey = s_suppkey group by 1 order by revenue desc, s_suppkey limit 5")
def o2_top_suppliers(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(total(F.col("l_extendedprice")).alias("revenue"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return g.join(s, "s_suppkey", "left_semi").orderBy(F.col("revenue").desc(), "s_suppkey").limit(5)


@query("select event_id, (props::json->>'$.k')::int as k from events")
def f21_json_path(spark, sf_dir):
    from tarnlake.sources.landing import virtual_columns

    return virtual_columns(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ("$.k", "int")}).select("event_id", "k")


@query("select s::date as full_date, strftime(s, '%Y%m%d')::int as date_sk, dayname(s) as day_name, monthname(s) as month_name, week(s) as week_of_year, quarter(s) as quarter, dayofweek(s) in (0, 6) as is_weekend, s::date = last_day(s::date) as is_month_end from (select unnest(generate_series(timestamp '2023-01-01', timestamp '2027-12-31', interval 1 day)) as s)")
def src13_calendar(spark, sf_dir):
    from tarnlake.sources.landing import calendar

    return calendar(spark, "2023-01-01", "2027-12-31").select("full_date", "date_sk", "day_name", "month_name", "week_of_year", "quarter", "is_weekend", "is_month_end")


@query("select l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) as days from lineitem join orders on o_orderkey = l_orderkey")
def f9_days_between(spark, sf_dir):
    from tarnlake.functions.columns import days_between

    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", days_between(F.col("o_orderdate"), F.col("l_shipdate")).cast("long").alias("days"))


@query("select c_custkey, case when c_acctbal < 0 then 'low' when c_acctbal <= 3000 then 'low' when c_acctbal > 3000 and c_acctbal <= 7000 then 'mid' else 'high' end as band from customer")
def f24_band_lookup(spark, sf_dir):
    from tarnlake.functions.columns import band

    return table(spark, sf_dir, "customer").select("c_custkey", band(F.col("c_acctbal"), [("low", 0, 3000), ("mid", 3000.000001, 7000), ("high", 7000.000001, 1e9)]).alias("band"))


@query("select o_orderkey, round(o_totalprice * (0.06 / 12) / (1 - power(1 + 0.06 / 12, -36)), 4) as instalment, round(least(o_totalprice, greatest(o_totalprice * 0.03, 25.0)), 4) as minimum from orders")
def f23_instalments(spark, sf_dir):
    from tarnlake.functions.columns import instalment, minimum_payment

    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(instalment(p, F.lit(0.06), F.lit(36)), 4).alias("instalment"), F.round(minimum_payment(p), 4).alias("minimum"))
