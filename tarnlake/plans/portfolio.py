"""Funnels, drill-downs, bridges, measures over two facts, model tests and the day's run (B, K, J, M, DQ, SRC, SNK, U), as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarnlake.functions.columns import ratio, total
from tarnlake.operators import quality, views
from tarnlake.operators.measures import Model
from tarnlake.operators.tables import Versioned
from tarnlake.operators.temporal import trailing_average
from tarnlake.plans.common import VERSIONS, table
from tarnlake.plans.history import _versions
from tarnlake.session import scratch_path
from tarnlake.sources import ingest, landing
from tarnlake.sources.contracts import load_contracts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("""with d as (select o_orderdate::date as day, cast(sum(cast(o_totalprice as decimal(18,2))) filter (o_orderstatus = 'F') as double) / nullif(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 0) as par from orders group by 1)
select day, round(avg(par) over (order by day range between interval 90 days preceding and current row), 6) as par_90d, round(avg(par) over (order by day range between interval 365 days preceding and current row), 6) as par_365d from d""")
def k11_rolling_par_year(spark, sf_dir):
    """The share of closed orders' amounts by date, averaged over 90 and 365 days, on years of dates."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    d = o.groupBy("day").agg(ratio(total(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), total(F.col("o_totalprice"))).alias("par"))
    d = trailing_average(trailing_average(d, F.col("par"), "day", 90, "a"), F.col("par"), "day", 365, "b")
    return d.select("day", F.round("a", 6).alias("par_90d"), F.round("b", 6).alias("par_365d"))


@query("""with e as (select user_id, ts::date as day, case user_id % 3 when 0 then 'CALL' when 1 then 'SMS' else 'MAIL' end as channel, event_type, value from events),
s as (select channel, user_id, day, bool_or(event_type in ('view', 'click', 'error')) as attempted, bool_or(event_type = 'click') as reached, bool_or(event_type = 'purchase') as promised, bool_or(event_type = 'purchase' and value >= 60) as kept from e group by 1, 2, 3),
f as (select channel, count(*) filter (attempted) as attempted, count(*) filter (attempted and reached) as rpc, count(*) filter (attempted and reached and promised) as ptp, count(*) filter (attempted and reached and promised and kept) as kept from s group by rollup(channel))
select coalesce(channel, 'ALL') as channel, attempted, rpc, ptp, kept, round(rpc / nullif(attempted, 0), 6) as rpc_rate, round(ptp / nullif(rpc, 0), 6) as ptp_rate, round(kept / nullif(ptp, 0), 6) as kept_rate from f""")
def b6_contact_funnel(spark, sf_dir):
    """Attempted, right party reached, promised, kept: a customer's day counts for a step if it has passed every step before; by channel and over all."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    kind, channel = F.col("event_type"), F.when(F.col("user_id") % 3 == 0, "CALL").when(F.col("user_id") % 3 == 1, "SMS").otherwise("MAIL")
    steps = {"attempted": kind.isin("view", "click", "error"), "rpc": kind == "click", "ptp": kind == "purchase", "kept": (kind == "purchase") & (F.col("value") >= 60)}
    days = e.groupBy(channel.alias("channel"), "user_id", "day").agg(*[F.bool_or(c).alias(n) for n, c in steps.items()])
    names = list(steps)
    passed = {n: reduce(lambda a, b: a & b, [F.col(x) for x in names[: i + 1]]) for i, n in enumerate(names)}
    f = days.rollup("channel").agg(*[F.count_if(c).alias(n) for n, c in passed.items()])
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6).alias(f"{a}_rate")
    return f.select(F.coalesce("channel", F.lit("ALL")).alias("channel"), *names, rate("rpc", "attempted"), rate("ptp", "rpc"), rate("kept", "ptp"))


@query("""with c as (select c_custkey as k from customer where c_custkey % 10 = 7),
t as (select o_custkey as customer, o_orderdate as happened, 'order' as kind, o_orderkey as id, o_totalprice as amount from orders
  union all select o_custkey, l_shipdate, case when l_returnflag = 'R' then 'return' else 'delivery' end, l_orderkey * 10 + l_linenumber, l_extendedprice from lineitem join orders on o_orderkey = l_orderkey
  union all select user_id, ts, 'contact', event_id, null from events where event_type <> 'purchase' union all select user_id, ts, 'promise', event_id, value from events where event_type = 'purchase')
select customer, happened, kind, id, round(amount, 2) as amount, row_number() over (partition by customer order by happened, kind, id, amount) as place from t where customer in (select k from c)""")
def b8_customer_drilldown(spark, sf_dir):
    """All that happened with one customer in ten, over orders, deliveries and returns, contacts and promises, in order."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").where("o_custkey % 10 = 7").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice")
    e = table(spark, sf_dir, "events").where("user_id % 10 = 7").select("user_id", "ts", "event_type", "event_id", "value")
    row = lambda df, who, at, kind, i, amount: df.select(F.col(who).alias("customer"), F.col(at).alias("happened"), kind.alias("kind"), i.alias("id"), amount.alias("amount"))
    orders = row(o, "o_custkey", "o_orderdate", F.lit("order"), F.col("o_orderkey"), F.col("o_totalprice"))
    lines = row(li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_shipdate", F.when(F.col("l_returnflag") == "R", "return").otherwise("delivery"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice"))
    promise = F.col("event_type") == "purchase"
    contacts = row(e, "user_id", "ts", F.when(promise, "promise").otherwise("contact"), F.col("event_id"), F.when(promise, F.col("value")))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    t = orders.unionByName(lines).unionByName(contacts).join(known, "customer", "left_semi")
    place = F.row_number().over(Window.partitionBy("customer").orderBy("happened", "kind", "id", F.col("amount").asc_nulls_last()))
    return t.select("customer", "happened", "kind", "id", F.round("amount", 2).alias("amount"), place.cast("long").alias("place"))


@query("""with m(event_type, channel_code) as (values ('click', 'CALL_OUT'), ('view', 'WEB'), ('purchase', 'APP')), ch(channel_code, channel_name, cost) as (values ('CALL_OUT', 'Outbound call', 3), ('WEB', 'Web', 0), ('APP', 'App', 1))
select event_id, e.event_type, channel_name, cost from events e left join m on m.event_type = e.event_type left join ch using (channel_code)""")
def j7_mapped_key_join(spark, sf_dir):
    """Each event with its channel, joined on a key that a map gives; what the map lacks stays, without a channel."""
    codes = {"click": "CALL_OUT", "view": "WEB", "purchase": "APP"}
    channels = spark.createDataFrame([("CALL_OUT", "Outbound call", 3), ("WEB", "Web", 0), ("APP", "App", 1)], "channel_code string, channel_name string, cost int")
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select("event_id", "event_type", code.alias("code"))
    # The channels are the three rows above.
    return e.join(F.broadcast(channels), F.col("code") == F.col("channel_code"), "left").select("event_id", "event_type", "channel_name", "cost")


@query("""select dayname(o_orderdate) as ordered_on, l_shipdate::date = last_day(l_shipdate::date) as shipped_at_month_end, quarter(l_shipdate) as shipped_in, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3""")
def j13_two_date_roles(spark, sf_dir):
    """The calendar as order date and as ship date: lines by the one's weekday and the other's quarter and month end."""
    cal = landing.calendar(spark, "1990-01-01", "2030-12-31")
    role = lambda name, *columns: F.broadcast(cal.select(F.col("full_date").alias(f"{name}_date"), *[F.col(c).alias(f"{name}_{c}") for c in columns]))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(role("order", "day_name"), F.col("day") == F.col("order_date")).join(role("ship", "quarter", "is_month_end"), F.col("ship") == F.col("ship_date"))
    return j.groupBy(F.col("order_day_name").alias("ordered_on"), F.col("ship_is_month_end").alias("shipped_at_month_end"), F.col("ship_quarter").cast("bigint").alias("shipped_in")).agg(F.count("*").alias("n"), total(F.col("l_quantity")).alias("quantity"))


@query("""with b as (select distinct o_custkey, l_suppkey from lineitem join orders on o_orderkey = l_orderkey),
w as (select o_custkey, l_suppkey, 1.0 / count(*) over (partition by o_custkey) as share from b)
select s_suppkey, s_name, count(*) as customers, round(sum(c_acctbal * share), 4) as weighted_balance, round(sum(share), 6) as whole_customers from w join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2""")
def j14_customer_supplier_bridge(spark, sf_dir):
    """Customers and suppliers through a bridge of distinct pairs with weights: a customer's balance is shared out among its suppliers, never repeated."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bridge = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    weight = bridge.groupBy("o_custkey").agg((1.0 / F.count("*")).alias("share"))
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = bridge.join(weight, "o_custkey").join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("s_suppkey", "s_name").agg(F.count("*").alias("customers"), F.round(F.sum(F.col("c_acctbal") * F.col("share")), 4).alias("weighted_balance"), F.round(F.sum("share"), 6).alias("whole_customers"))


@query("""with o as (select n_name, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as ordered, cast(sum(cast(o_totalprice as decimal(18,2))) filter (o_orderstatus = 'F') as double) as closed from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey group by 1),
l as (select n_name, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as shipped, count(distinct o_orderpriority) as priorities from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey group by 1)
select n_name, orders, ordered, closed, shipped, priorities, round(shipped / nullif(ordered, 0), 6) as shipped_share from o full join l using (n_name)""")
def m8_two_facts(spark, sf_dir):
    """Measures of two facts by a dimension that they share; the second fact reaches it, and a column of the first, through its link to the first."""
    get = lambda n, *c: table(spark, sf_dir, n).select(*c)
    m = Model(
        {"orders": get("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "lineitem": get("lineitem", "l_orderkey", "l_extendedprice"), "customer": get("customer", "c_custkey", "c_nationkey"), "nation": get("nation", "n_nationkey", "n_name")},
        {("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("orders", "o_custkey"): ("customer", "c_custkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey")},
    )
    m.measure("orders", "orders", lambda keep: F.count_if(keep))
    m.measure("ordered", "orders", lambda keep: total(F.when(keep, F.col("o_totalprice"))))
    m.measure("closed", "orders", lambda keep: total(F.when(keep & (F.col("o_orderstatus") == "F"), F.col("o_totalprice"))))
    m.measure("shipped", "lineitem", lambda keep: total(F.when(keep, F.col("l_extendedprice"))))
    m.measure("priorities", "lineitem", lambda keep: F.count_distinct(F.when(keep, F.col("o_orderpriority"))))
    m.divide("shipped_share", "shipped", "ordered")
    return m.evaluate(["orders", "ordered", "closed", "shipped", "priorities", "shipped_share"], ["n_name"]).withColumn("shipped_share", F.round("shipped_share", 6))


@query("select year(o_orderdate)::int as year, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount, case when o_orderdate < timestamp '2000-01-01' then 'stored' else 'live' end as source from orders group by 1, 4")
def m10_stored_and_live(spark, sf_dir):
    """A composed table: history from a stored aggregate that its mark keeps, the open end computed where it is read."""
    o, cut = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"), F.lit("2000-01-01").cast("timestamp_ntz")
    by_year = lambda df: df.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), total(F.col("o_totalprice")).alias("amount"))
    stored = views.Materialized(Versioned(spark, scratch_path(spark, "history")))
    built = [stored.refresh("closed-2000", lambda: by_year(o.where(F.col("o_orderdate") < cut))) for _ in range(2)]
    views.replace_view(by_year(o.where(F.col("o_orderdate") >= cut)), "tarnlake_live_orders")
    live = spark.table("tarnlake_live_orders").withColumn("source", F.lit("live"))
    return stored.read().withColumn("source", F.lit("stored")).unionByName(live) if built == [True, False] else live


_MODEL = """
models:
  - name: orders
    tests: [{unique_combination: {columns: [o_custkey, o_orderdate], severity: warn}}]
    columns:
      - {name: o_orderkey, tests: [not_null, unique]}
      - {name: o_custkey, tests: [not_null, {relationships: {to: customer, field: c_custkey}}]}
      - {name: o_orderstatus, tests: [{accepted_values: {values: [F, O]}}]}
  - name: lineitem
    columns:
      - {name: l_orderkey, tests: [{relationships: {to: open_orders, field: o_orderkey}}]}
      - {name: l_returnflag, tests: [not_null, {accepted_values: {values: [A, N], severity: warn}}]}
"""
_TESTS = """t(table_name, check_name, severity, failed_count) as (values
  ('orders', 'unique_combination_o_custkey_o_orderdate', 'WARN', (select count(*) - count(distinct (o_custkey, o_orderdate)) from orders)),
  ('orders', 'not_null_o_orderkey', 'FAIL', (select count(*) filter (o_orderkey is null) from orders)), ('orders', 'unique_o_orderkey', 'FAIL', (select count(o_orderkey) - count(distinct o_orderkey) from orders)),
  ('orders', 'not_null_o_custkey', 'FAIL', (select count(*) filter (o_custkey is null) from orders)), ('orders', 'relationships_o_custkey', 'FAIL', (select count(*) from orders where o_custkey not in (select c_custkey from customer))),
  ('orders', 'accepted_values_o_orderstatus', 'FAIL', (select count(*) from orders where o_orderstatus not in ('F', 'O'))),
  ('lineitem', 'relationships_l_orderkey', 'FAIL', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O'))),
  ('lineitem', 'not_null_l_returnflag', 'FAIL', (select count(*) filter (l_returnflag is null) from lineitem)), ('lineitem', 'accepted_values_l_returnflag', 'WARN', (select count(*) from lineitem where l_returnflag not in ('A', 'N'))))"""
_STATUS = "case when failed_count > 0 then 'FAILED' else 'PASSED' end"


def _tested(spark, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer")}
    t["open_orders"] = t["orders"].where("o_orderstatus = 'O'")
    return quality.run_checks(t, quality.load_schema_tests(_MODEL), spark)


@query(f"with {_TESTS} select table_name, check_name, severity, failed_count::bigint as failed_count, {_STATUS} as status from t")
def dq14_model_tests(spark, sf_dir):
    """Tests of models from YAML: not null, unique, unique together, accepted values and relationships."""
    return _tested(spark, sf_dir).select("table_name", "check_name", "severity", "failed_count", "status")


@query(f"with {_TESTS} select row_number() over (order by failed_count = 0, severity, table_name, check_name)::int as place, table_name, check_name, {_STATUS} as status, failed_count::bigint as failed_count, 2 as runs from t")
def snk12_dashboard(spark, sf_dir):
    """The latest of two stored runs as the dashboard orders it: failures first."""
    path = scratch_path(spark, "results")
    for _ in range(2):
        quality.append_results(_tested(spark, sf_dir), path)
    held = spark.read.parquet(path)
    runs = held.select("run_id").distinct().count()
    html = quality.dashboard(held)
    rows = quality.dashboard_rows(held).withColumn("shown", F.lit(html).contains(F.col("check_name")))
    return rows.where("shown").select("place", "table_name", "check_name", "status", "failed_count", F.lit(runs).alias("runs"))


@query(f"""with {VERSIONS}, {_TESTS}, dup as (select o_custkey from versions where effective_end = timestamp '9999-12-31' and o_custkey % 50 = 0)
select * from (values ('rows:versions', (select count(*) from versions) + (select count(*) from dup), true), ('rows:none', 0, false), ('open_versions:versions', (select count(*) from dup), (select count(*) from dup) = 0),
  ('orphans:versions.o_custkey', (select count(*) from (select o_custkey from versions union all select o_custkey from dup) where o_custkey not in (select c_custkey from customer where c_custkey % 30 <> 0)), false),
  ('last_run:failed', (select count(*) from t where severity = 'FAIL' and failed_count > 0), (select count(*) from t where severity = 'FAIL' and failed_count > 0) = 0)) h(item, value, healthy)""")
def dq13_health_of_versions(spark, sf_dir):
    """A history in which some keys have two open versions, a key without its parent, an empty table, and the last run of checks."""
    v = _versions(spark, sf_dir)
    twice = v.unionByName(v.where("is_current and o_custkey % 50 = 0"))
    parents = table(spark, sf_dir, "customer").where("c_custkey % 30 <> 0")
    t = {"versions": twice, "none": v.limit(0), "customer": parents}
    h = quality.health({k: t[k] for k in t}, {"versions": "o_custkey"}, [("versions", "o_custkey", "customer", "c_custkey")], spark, _tested(spark, sf_dir))
    return h.where("item <> 'rows:customer'")


@query("""with r(name, achieved, wanted, tolerance) as (select unnest(['returned', 'late', 'large']), unnest([avg((l_returnflag = 'R')::int::double), avg((l_shipdate > o_orderdate + interval 60 days)::int::double), avg((l_quantity >= 40)::int::double)]), unnest([0.33, 0.5, 0.1]), unnest([0.05, 0.2, 0.01]) from lineitem join orders on o_orderkey = l_orderkey)
select name, round(achieved, 6) as achieved, wanted::double as wanted, tolerance::double as tolerance, abs(achieved - wanted) <= tolerance as ok from r""")
def dq16_achieved_rates(spark, sf_dir):
    """What shares of the landed lines were returned, late and large, against what was wanted."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", "l_quantity")
    j = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rates = {"returned": (F.col("l_returnflag") == "R", 0.33, 0.05), "late": (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days"), 0.5, 0.2), "large": (F.col("l_quantity") >= 40, 0.1, 0.01)}
    return quality.achieved_rates(j, rates).withColumn("achieved", F.round("achieved", 6))


_REGISTRY = """
tables:
  nation: {path: "%s/nation/dt={date}", natural_key: [n_nationkey], columns: {n_nationkey: int, n_name: string, n_regionkey: int}}
  supplier: {path: "%s/supplier/dt={date}", natural_key: [s_suppkey], columns: {s_suppkey: bigint, s_name: string, s_acctbal: double}}
  customer: {path: "%s/customer/dt={date}", natural_key: [c_custkey], columns: {c_custkey: bigint, c_name: string, c_acctbal: double}}
  part: {path: "%s/part/dt={date}", natural_key: [p_partkey], columns: {p_partkey: bigint, p_name: string}}
"""


@query("""select day, name as table_name, status, clean as row_count, held as quarantined_count, bronze_rows from (
  select '2025-01-01' as day, 'nation' as name, 'SUCCESS' as status, count(*) as clean, 0 as held, count(*) as bronze_rows from nation
  union all select '2025-01-01', 'supplier', 'SUCCESS', count(*) filter (s_suppkey % 10 <> 0), count(*) filter (s_suppkey % 10 = 0), count(*) filter (s_suppkey % 10 <> 0) from supplier
  union all select '2025-01-01', 'customer', 'BREAKING_DRIFT', 0, count(*), 0 from customer union all select '2025-01-01', 'part', 'NO_FILE_LANDED', 0, 0, 0
  union all select '2025-01-02', t, 'NO_FILE_LANDED', 0, 0, 0 from (select unnest(['nation', 'supplier', 'customer']) as t) union all select '2025-01-02', 'part', 'SUCCESS', count(*), 0, count(*) from part)""")
def src18_src19_day(spark, sf_dir):
    """Two days of all tables of a registry in YAML: one table has rows that do not parse, one lacks a promised column, and absent files are skipped."""
    land, bronze, side, log = (scratch_path(spark, n) for n in ("land", "bronze", "quarantine", "log"))
    put = lambda df, name, day: df.write.option("header", True).csv(f"{land}/{name}/dt={day}")
    put(table(spark, sf_dir, "nation"), "nation", "2025-01-01")
    put(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 10 == 0, "much").otherwise(F.col("s_acctbal").cast("string")).alias("s_acctbal")), "supplier", "2025-01-01")
    put(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "customer", "2025-01-01")
    put(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "part", "2025-01-02")
    contracts, rows = load_contracts(_REGISTRY % ((land,) * 4)), {}
    for day in ("2025-01-01", "2025-01-02", "2025-01-01"):
        for r in ingest.ingest_day(spark, contracts, day, bronze, side, log):
            rows[day, r["table_name"]] = (r["status"], r["row_count"], r["quarantined_count"])
    n = {(str(r.day), name): r["count"] for name in ("nation", "supplier", "part") for r in spark.read.parquet(f"{bronze}/{name}").groupBy(F.col("_ingestion_date").alias("day")).count().collect()}
    return spark.createDataFrame([(*k, *v, n.get(k, 0)) for k, v in rows.items()], "day string, table_name string, status string, row_count long, quarantined_count long, bronze_rows long")


@query("select c_mktsegment, count(*) as n, true as stamped, true as by_user, true as not_early from customer group by 1")
def f18_audit_stamp(spark, sf_dir):
    """Each row with who wrote it and when: one time for the whole statement, the session's user, not before the job began."""
    path, began = scratch_path(spark, "audit"), spark.sql("select current_timestamp()").first()[0]
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.current_timestamp().alias("at"), F.current_user().alias("who"))
    c.write.parquet(path)
    user = spark.sql("select current_user()").first()[0]
    held = spark.read.parquet(path)
    times = held.agg(F.count_distinct("at").alias("times"))
    g = held.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.bool_and(F.col("at").isNotNull()).alias("set"), F.bool_and(F.col("who") == user).alias("by_user"), F.bool_and(F.col("at") >= F.lit(began)).alias("not_early"))
    return g.crossJoin(F.broadcast(times)).select("c_mktsegment", "n", (F.col("set") & (F.col("times") == 1)).alias("stamped"), "by_user", "not_early")


@query("""select o_orderstatus, count(*) as row_count, case when count(*) filter (o_totalprice > 490000) > 0 then 'ALERT' else 'SUCCESS' end as status, count(*) filter (o_totalprice > 490000) as large from orders group by 1""")
def u8_logged_steps(spark, sf_dir):
    """Steps that log themselves: each writes its rows, and its log row has the counts that were observed while it wrote, with an alert where rows are too large."""
    log, out = scratch_path(spark, "steps"), scratch_path(spark, "written")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for status in ("F", "O", "P"):
        seen = Observation()
        o.where(F.col("o_orderstatus") == status).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 490000).alias("large")).write.parquet(f"{out}/{status}")
        n, large = seen.get["n"], seen.get["large"]
        spark.createDataFrame([(status, n, "ALERT" if large else "SUCCESS", large)], "o_orderstatus string, row_count long, status string, large long").write.mode("append").parquet(log)
    return spark.read.parquet(log)
