"""Portfolio measures (K), semantic-layer shapes (M) and dashboard shapes (B) over the snapshot analogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnlake.functions.columns import bucket_label, rag, ratio, total
from tarnlake.operators.measures import Model, calendar_rollup
from tarnlake.operators.temporal import moving_average, shifted, trailing_average
from tarnlake.plans.common import PTP, SNAP, flagged, promises, snapshots, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _over(low: int, high: int = 99):
    return total(F.when(F.col("bucket_index").between(low, high), F.col("balance")))


def _par(s, low=(1, 2, 4), high=(99, 99, 99)):
    g = s.groupBy("snapshot_date").agg(total(F.col("balance")).alias("total_balance"), *[F.coalesce(_over(a, b), F.lit(0.0)).alias(f"balance_{n}") for a, b, n in zip(low, high, (30, 60, 90))])
    return g.select("*", *[F.round(ratio(F.col(f"balance_{n}"), F.col("total_balance")), 6).alias(f"par_{n}") for n in (30, 60, 90)])


def _par_sql(cond):
    b = ", ".join(f"coalesce(cast(sum(balance) filter ({c}) as double), 0) as balance_{n}" for c, n in zip(cond, (30, 60, 90)))
    r = ", ".join(f"round(balance_{n} / nullif(total_balance, 0), 6) as par_{n}" for n in (30, 60, 90))
    return f"with {SNAP}, g as (select snapshot_date, cast(sum(balance) as double) as total_balance, {b} from snap group by 1) select *, {r} from g"


@query(_par_sql(("bucket_index >= 1", "bucket_index >= 2", "bucket_index >= 4")))
def k1_portfolio_at_risk(spark, sf_dir):
    return _par(snapshots(spark, sf_dir))


@query(_par_sql(("bucket_index >= 2", "bucket_index >= 3", "bucket_index = 4")))
def k1_portfolio_at_risk_strict(spark, sf_dir):
    return _par(snapshots(spark, sf_dir), (2, 3, 4), (99, 99, 4))


@query(f"with {SNAP} select snapshot_date, count(*) filter (bucket_index > 0) as population, count(*) filter (roll_flag) as rolled, round(count(*) filter (roll_flag) / nullif(count(*) filter (bucket_index > 0), 0), 6) as roll_rate from flags group by 1")
def k2_roll_rate_daily(spark, sf_dir):
    g = flagged(spark, sf_dir).groupBy("snapshot_date").agg(F.count_if(F.col("bucket_index") > 0).alias("population"), F.count_if("roll_flag").alias("rolled"))
    return g.withColumn("roll_rate", F.round(ratio(F.col("rolled"), F.col("population")), 6))


@query(f"with {SNAP} select snapshot_date, count(*) filter (prior_bucket > 0) as population, count(*) filter (prior_bucket > 0 and bucket_index > prior_bucket) as rolled, round(count(*) filter (prior_bucket > 0 and bucket_index > prior_bucket) / nullif(count(*) filter (prior_bucket > 0), 0), 6) as roll_rate from flags group by 1")
def k2_roll_rate_of_yesterday(spark, sf_dir):
    late = F.col("prior_bucket") > 0
    g = flagged(spark, sf_dir).groupBy("snapshot_date").agg(F.count_if(late).alias("population"), F.count_if(late & (F.col("bucket_index") > F.col("prior_bucket"))).alias("rolled"))
    return g.withColumn("roll_rate", F.round(ratio(F.col("rolled"), F.col("population")), 6))


@query(f"with {SNAP} select snapshot_date, count(*) filter (prior_bucket > 0) as population, count(*) filter (cure_flag) as cured, round(count(*) filter (cure_flag) / nullif(count(*) filter (prior_bucket > 0), 0), 6) as cure_rate from flags group by 1")
def k3_cure_rate_daily(spark, sf_dir):
    g = flagged(spark, sf_dir).groupBy("snapshot_date").agg(F.count_if(F.col("prior_bucket") > 0).alias("population"), F.count_if("cure_flag").alias("cured"))
    return g.withColumn("cure_rate", F.round(ratio(F.col("cured"), F.col("population")), 6))


_REC = "select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as recovered, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as originated from orders left join (select l_orderkey, l_extendedprice from lineitem where l_returnflag = 'R') on o_orderkey = l_orderkey where o_orderstatus = 'F'"


@query(f"select *, round(recovered / nullif(originated, 0), 6) as recovery_rate from ({_REC})")
def k4_recovery_rate(spark, sf_dir):
    """The literal join, which repeats an order's amount for each of its payments."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    p = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")
    g = o.join(p, o.o_orderkey == p.l_orderkey, "left").agg(total(F.col("l_extendedprice")).alias("recovered"), total(F.col("o_totalprice")).alias("originated"))
    return g.withColumn("recovery_rate", F.round(ratio(F.col("recovered"), F.col("originated")), 6))


@query("with p as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as paid from lineitem where l_returnflag = 'R' group by 1), g as (select cast(sum(paid) as double) as recovered, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as originated from orders left join p on o_orderkey = l_orderkey where o_orderstatus = 'F') select *, round(recovered / nullif(originated, 0), 6) as recovery_rate from g")
def k4_recovery_rate_once(spark, sf_dir):
    """Payments are added up before the join, so no amount repeats."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    p = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("paid"))
    g = o.join(p, o.o_orderkey == p.l_orderkey, "left").agg(F.sum("paid").cast("double").alias("recovered"), total(F.col("o_totalprice")).alias("originated"))
    return g.withColumn("recovery_rate", F.round(ratio(F.col("recovered"), F.col("originated")), 6))


@query("select count(*) as attempts, count(*) filter (event_type = 'click') as connected, round(count(*) filter (event_type = 'click') / nullif(count(*), 0), 6) as connect_rate from events where event_type in ('click', 'view')")
def k5_connect_rate(spark, sf_dir):
    g = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "click").alias("connected"))
    return g.withColumn("connect_rate", F.round(ratio(F.col("connected"), F.col("attempts")), 6))


@query(f"with {PTP} select count(*) as promises, count(*) filter (ptp_status = 'Kept') as kept, round(count(*) filter (ptp_status = 'Kept') / nullif(count(*), 0), 6) as fulfilment_rate from ptp")
def k6_promise_fulfilment(spark, sf_dir):
    g = promises(spark, sf_dir).agg(F.count("*").alias("promises"), F.count_if(F.col("ptp_status") == "Kept").alias("kept"))
    return g.withColumn("fulfilment_rate", F.round(ratio(F.col("kept"), F.col("promises")), 6))


@query("select c.user_id, count(distinct c.event_id) as contacts, count(distinct p.event_id) as promises, cast(coalesce(sum(cast(p.value as decimal(18,2))), 0) as double) as promised from (select * from events where event_type = 'click') c left join (select * from events where event_type = 'purchase') p using (user_id) group by 1")
def k7_productivity_fan_out(spark, sf_dir):
    """The literal double join: contacts multiply promises, and the sum with them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    c, p = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("c_id")), e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"), "value")
    return c.join(p, "user_id", "left").groupBy("user_id").agg(F.count_distinct("c_id").alias("contacts"), F.count_distinct("p_id").alias("promises"), F.coalesce(total(F.col("value")), F.lit(0.0)).alias("promised"))


@query("select user_id, count(*) filter (event_type = 'click') as contacts, count(*) filter (event_type = 'purchase') as promises, cast(coalesce(sum(cast(value as decimal(18,2))) filter (event_type = 'purchase'), 0) as double) as promised from events group by 1 having count(*) filter (event_type = 'click') > 0")
def k7_productivity(spark, sf_dir):
    """Both sides in one pass, so neither multiplies the other."""
    is_ = lambda k: F.col("event_type") == k
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(is_("click")).alias("contacts"), F.count_if(is_("purchase")).alias("promises"), F.coalesce(total(F.when(is_("purchase"), F.col("value"))), F.lit(0.0)).alias("promised"))
    return g.where("contacts > 0")


@query(f"with {SNAP} select snapshot_date, round(avg(bucket_index::double), 6) as avg_days from snap where bucket_index between 1 and 4 group by 1")
def k8_average_days_delinquent(spark, sf_dir):
    return snapshots(spark, sf_dir).where(F.col("bucket_index").between(1, 4)).groupBy("snapshot_date").agg(F.round(F.avg(F.col("bucket_index").cast("double")), 6).alias("avg_days"))


@query(f"with {SNAP} select snapshot_date, cast(coalesce(sum(balance) filter (cure_flag), 0) as double) as cured_balance, cast(coalesce(sum(balance) filter (prior_bucket > 0), 0) as double) as delinquent_balance, round(cast(coalesce(sum(balance) filter (cure_flag), 0) as double) / nullif(cast(coalesce(sum(balance) filter (prior_bucket > 0), 0) as double), 0), 6) as efficiency from flags group by 1")
def k9_collection_efficiency(spark, sf_dir):
    z = F.lit(0.0)
    g = flagged(spark, sf_dir).groupBy("snapshot_date").agg(F.coalesce(total(F.when(F.col("cure_flag"), F.col("balance"))), z).alias("cured_balance"), F.coalesce(total(F.when(F.col("prior_bucket") > 0, F.col("balance"))), z).alias("delinquent_balance"))
    return g.withColumn("efficiency", F.round(ratio(F.col("cured_balance"), F.col("delinquent_balance")), 6))


@query("with c as (select user_id, ts::date as d, event_id from events where event_type = 'click'), p as (select distinct user_id, ts::date as d from events where event_type = 'purchase') select count(*) as contacts, count(*) filter (exists (select 1 from p where p.user_id = c.user_id and p.d = c.d)) as successes, round(count(*) filter (exists (select 1 from p where p.user_id = c.user_id and p.d = c.d)) / nullif(count(*), 0), 6) as success_rate from c")
def k10_contact_success(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    p = e.where("event_type = 'purchase'").select("user_id", "d").distinct().withColumn("hit", F.lit(True))
    g = e.where("event_type = 'click'").join(p, ["user_id", "d"], "left").agg(F.count("*").alias("contacts"), F.count_if("hit").alias("successes"))
    return g.withColumn("success_rate", F.round(ratio(F.col("successes"), F.col("contacts")), 6))


@query(f"with {SNAP}, p as (select snapshot_date, cast(sum(balance) filter (bucket_index >= 1) as double) / nullif(cast(sum(balance) as double), 0) as par from snap group by 1) select snapshot_date, round(avg(par) over (order by snapshot_date range between interval 7 days preceding and current row), 6) as par_7d, round(avg(par) over (order by snapshot_date range between interval 90 days preceding and current row), 6) as par_90d from p")
def k11_rolling_par(spark, sf_dir):
    g = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(ratio(_over(1), total(F.col("balance"))).alias("par"))
    g = trailing_average(trailing_average(g, F.col("par"), "snapshot_date", 7, "a"), F.col("par"), "snapshot_date", 90, "b")
    return g.select("snapshot_date", F.round("a", 6).alias("par_7d"), F.round("b", 6).alias("par_90d"))


@query("with l as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderstatus = 'O') where rn = 1) select c_custkey, c_name, n_name, o_orderkey, o_orderpriority, o_totalprice, row_number() over (order by o_orderpriority, o_totalprice desc, c_custkey) as worklist_rank from l join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def k12_worklist(spark, sf_dir):
    from tarnlake.operators.merge import latest, sequence_key

    o = latest(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    w = c.join(o, c.c_custkey == o.o_custkey).join(n, c.c_nationkey == n.n_nationkey, "left")
    w = w.select("c_custkey", "c_name", "n_name", "o_orderkey", "o_orderpriority", "o_totalprice", F.negate("o_totalprice").alias("_neg"))
    return sequence_key(w, ["o_orderpriority", "_neg", "c_custkey"], name="worklist_rank").drop("_neg")


@query(f"with {SNAP} select round(count(*) filter (roll_flag) / nullif(count(*) filter (bucket_index > 0), 0), 6) as roll_rate, round(count(*) filter (cure_flag) / nullif(count(*) filter (prior_bucket > 0), 0), 6) as cure_rate, round(avg(case when bucket_index > 0 then bucket_index::double end), 6) as avg_bucket from flags")
def k13_pooled_rates(spark, sf_dir):
    late = F.col("bucket_index") > 0
    return flagged(spark, sf_dir).agg(F.round(ratio(F.count_if("roll_flag"), F.count_if(late)), 6).alias("roll_rate"), F.round(ratio(F.count_if("cure_flag"), F.count_if(F.col("prior_bucket") > 0)), 6).alias("cure_rate"), F.round(F.avg(F.when(late, F.col("bucket_index").cast("double"))), 6).alias("avg_bucket"))


@query("select n_name, r_name, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance, cast(coalesce(sum(cast(c_acctbal as decimal(18,2))) filter (c_acctbal < 0), 0) as double) as overdrawn, round(cast(coalesce(sum(cast(c_acctbal as decimal(18,2))) filter (c_acctbal < 0), 0) as double) / nullif(cast(sum(cast(c_acctbal as decimal(18,2))) as double), 0), 6) as overdrawn_share from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey group by 1, 2")
def m1_measure_model(spark, sf_dir):
    """Measures by name over a star, one with its own filter, and a ratio of two."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    m = Model({"customer": table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), "nation": n}, {("customer", "c_nationkey"): ("nation", "n_nationkey")})
    for name in ("balance", "overdrawn"):
        m.measure(name, "customer", lambda keep: F.coalesce(total(F.when(keep, F.col("c_acctbal"))), F.lit(0.0)))
    m.divide("overdrawn_share", "overdrawn", "balance")
    out = m.evaluate(["balance", "overdrawn", "overdrawn_share"], ["n_name", "r_name"], {"overdrawn": F.col("c_acctbal") < 0})
    return out.withColumn("overdrawn_share", F.round("overdrawn_share", 6))


_PAR1 = f"with {SNAP}, p as (select snapshot_date, cast(sum(balance) filter (bucket_index >= 1) as double) / nullif(cast(sum(balance) as double), 0) as par from snap group by 1)"


@query(f"{_PAR1} select a.snapshot_date, round(a.par, 6) as par, round(b.par, 6) as par_7d_ago, round((a.par - b.par) / nullif(b.par, 0), 6) as change from p a left join p b on b.snapshot_date = a.snapshot_date - interval 7 days")
def m4_time_shift(spark, sf_dir):
    g = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(ratio(_over(1), total(F.col("balance"))).alias("par"))
    s = shifted(g, "snapshot_date", ["par"], F.date_sub("snapshot_date", 7), "_7d_ago")
    return s.select("snapshot_date", F.round("par", 6).alias("par"), F.round("par_7d_ago", 6).alias("par_7d_ago"), F.round(ratio(F.col("par") - F.col("par_7d_ago"), F.col("par_7d_ago")), 6).alias("change"))


@query(f"{_PAR1} select snapshot_date, case when par >= 0.5 then 'Red' when par >= 0.3 then 'Amber' when par is not null then 'Green' end as status from p")
def m7_status_colours(spark, sf_dir):
    g = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(ratio(_over(1), total(F.col("balance"))).alias("par"))
    return g.select("snapshot_date", rag(F.col("par"), 0.5, 0.3).alias("status"))


@query("select year(o_orderdate)::int as year, quarter(o_orderdate)::int as quarter, month(o_orderdate)::int as month, day(o_orderdate)::int as day, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount, count(*) as n from orders group by rollup(1, 2, 3, 4)")
def m9_calendar_rollup(spark, sf_dir):
    return calendar_rollup(table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"), "o_orderdate", [total(F.col("o_totalprice")).alias("amount"), F.count("*").alias("n")])


@query("select c_mktsegment, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance, count(*) as customers from customer group by 1")
def b1_balance_by_segment(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(total(F.col("c_acctbal")).alias("balance"), F.count("*").alias("customers"))


@query("select c_mktsegment, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as status_{s}" for s in "FOP") + " from customer join orders on o_custkey = c_custkey group by 1")
def b2_segment_status_matrix(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    g = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return g.select("c_mktsegment", *[F.coalesce(s, F.lit(0)).alias(f"status_{s}") for s in "FOP"])


@query(f"with {SNAP} select coalesce(prior_bucket, -1) as prior_bucket, bucket_index, count(*) as n from flags group by 1, 2")
def b3_transition_matrix(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy(F.coalesce("prior_bucket", F.lit(-1)).alias("prior_bucket"), "bucket_index").agg(F.count("*").alias("n"))


@query(f"with {SNAP} select date_trunc('week', snapshot_date)::date as week, bucket_index, round(avg(roll_flag::int::double), 6) as roll_share from flags group by 1, 2")
def b4_roll_heatmap(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy(F.trunc("snapshot_date", "week").alias("week"), "bucket_index").agg(F.round(F.avg(F.col("roll_flag").cast("double")), 6).alias("roll_share"))


@query("select date_trunc('month', l_shipdate)::date as month, cast(sum(cast(l_extendedprice as decimal(18,2))) filter (l_returnflag = 'R') as double) as returned, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as shipped from lineitem group by 1")
def b5_recovery_by_month(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(total(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("returned"), total(F.col("l_extendedprice")).alias("shipped"))


@query("select event_type, least(10, floor(value / 10))::bigint as bin, count(*) as n from events group by 1, 2")
def b6_value_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.least(F.lit(10), F.floor(F.col("value") / 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select user_id, ts, 'contact' as kind, value from events where user_id = 7 and event_type in ('click', 'view') union all select user_id, ts, 'promise', value from events where user_id = 7 and event_type = 'purchase'")
def b8_entity_timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id = 7")
    part = lambda kinds, name: e.where(F.col("event_type").isin(*kinds)).select("user_id", "ts", F.lit(name).alias("kind"), "value")
    return part(["click", "view"], "contact").unionByName(part(["purchase"], "promise")).orderBy("ts")


@query("with m as (select date_trunc('month', o_orderdate)::date as month, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1) select a.month, a.amount, b.amount as amount_before, round((a.amount - b.amount) / nullif(b.amount, 0), 6) as change from m a left join m b on b.month = (a.month - interval 1 month)::date")
def b9_month_over_month(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(total(F.col("o_totalprice")).alias("amount"))
    s = shifted(g, "month", ["amount"], F.add_months("month", -1), "_before")
    return s.withColumn("change", F.round(ratio(F.col("amount") - F.col("amount_before"), F.col("amount_before")), 6))


@query("select case when l_shipdate < timestamp '2000-01-01' then date_trunc('week', l_shipdate)::date else l_shipdate::date end as period, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by 1")
def b10_weekly_history(spark, sf_dir):
    """History older than a cutoff by week, the rest by day."""
    old = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    period = F.when(old, F.trunc("l_shipdate", "week")).otherwise(F.to_date("l_shipdate"))
    return table(spark, sf_dir, "lineitem").groupBy(period.alias("period")).agg(F.count("*").alias("n"), total(F.col("l_quantity")).alias("quantity"))


@query(f"{_PAR1} select a.snapshot_date, abs(a.par - b.par) / nullif(b.par, 0) > 0.05 as alert from p a join p b on b.snapshot_date = a.snapshot_date - interval 7 days")
def b11_weekly_alert(spark, sf_dir):
    g = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(ratio(_over(1), total(F.col("balance"))).alias("par"))
    s = shifted(g, "snapshot_date", ["par"], F.date_sub("snapshot_date", 7), "_before").where("par_before is not null")
    return s.select("snapshot_date", (ratio(F.abs(F.col("par") - F.col("par_before")), F.col("par_before")) > 0.05).alias("alert"))


@query("select dayofweek(o_orderdate) in (0, 6) as is_weekend, o_orderdate::date = last_day(o_orderdate::date) as is_month_end, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1, 2")
def b12_calendar_slices(spark, sf_dir):
    from tarnlake.sources.landing import calendar

    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    cal = calendar(spark, "1990-01-01", "2030-12-31").select("full_date", "is_weekend", "is_month_end")
    return o.join(F.broadcast(cal), o.d == cal.full_date).groupBy("is_weekend", "is_month_end").agg(F.count("*").alias("n"), total(F.col("o_totalprice")).alias("amount"))


@query(f"with {SNAP}, w as (select user_id, date_trunc('week', snapshot_date)::date as week, max(bucket_index) as worst from snap group by 1, 2), m as (select *, lag(worst) over (partition by user_id order by week) as before from w) select before, worst, count(*) as n from m where before is not null group by 1, 2")
def b13_band_migration(spark, sf_dir):
    w = snapshots(spark, sf_dir).groupBy("user_id", F.trunc("snapshot_date", "week").alias("week")).agg(F.max("bucket_index").alias("worst"))
    m = w.withColumn("before", F.lag("worst").over(Window.partitionBy("user_id").orderBy("week"))).where("before is not null")
    return m.groupBy("before", "worst").agg(F.count("*").alias("n"))


@query("with d as (select ts::date as day, count(*) as n from events where event_type = 'error' group by 1) select day, n, round(avg(n) over (order by day rows between 6 preceding and current row), 6) as n_7d from d")
def w9_moving_average(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return moving_average(d, F.col("n"), "day", 7, "m").select("day", "n", F.round("m", 6).alias("n_7d"))


@query(f"with {SNAP} select bucket_index, case bucket_index when 0 then 'Current' when 1 then '1-29' when 2 then '30-59' when 3 then '60-89' when 4 then '90+' end as label, count(*) as n from snap group by 1, 2")
def f1_bucket_labels(spark, sf_dir):
    return snapshots(spark, sf_dir).groupBy("bucket_index", bucket_label(F.col("bucket_index")).alias("label")).agg(F.count("*").alias("n"))
