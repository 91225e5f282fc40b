"""The daily report, access by layer, retention, job graphs, promises as a stream, and the generators' rules, as queries.

The generators draw by hashes that SQL does not have, so their queries return what must hold for every row: how many rows
there are and how many break a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tarnlake.functions.columns import money, ratio
from tarnlake.operators import quality, security, tables
from tarnlake.plans import orchestrate
from tarnlake.plans.common import PTP, SNAP, promises, snapshots, table
from tarnlake.plans.kpis import k2_roll_rate_daily, k3_cure_rate_daily
from tarnlake.session import materialize, scratch_path
from tarnlake.sources import generate
from tarnlake.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""with {SNAP}, {PTP},
par as (select snapshot_date, cast(sum(balance) filter (bucket_index >= 2) as double) / nullif(cast(sum(balance) as double), 0) as v from snap group by 1 order by 1 desc limit 30),
rates as (select snapshot_date, round(count(*) filter (roll_flag) / nullif(count(*) filter (bucket_index > 0), 0), 6) as roll, round(count(*) filter (cure_flag) / nullif(count(*) filter (prior_bucket > 0), 0), 6) as cure from flags group by 1),
kept as (select user_id, cast(sum(cast(value as decimal(18,2))) as double) as v from ptp where ptp_status = 'Kept' group by 1 order by v desc, user_id limit 5)
select 'par' as section, strftime(snapshot_date, '%Y-%m-%d') as name, round(v, 6) as value from par
union all select 'rate', 'roll', round(avg(roll) * 100, 2) from rates
union all select 'rate', 'cure', round(avg(cure) * 100, 2) from rates
union all select 'rate', 'kept', round(100 * count(*) filter (ptp_status = 'Kept') / nullif(count(*), 0), 2) from ptp
union all select 'top', user_id::varchar, v from kept""")
def snk13_daily_report(spark, sf_dir):
    """The last 30 days' share at risk, mean rates in percent, and the five with most kept promises."""
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))
    at_risk = money(F.sum(F.when(F.col("bucket_index") >= 2, F.col("balance"))))
    par = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(F.round(ratio(at_risk, money(F.sum("balance"))), 6).alias("v"))
    out = [row(par.orderBy(F.col("snapshot_date").desc()).limit(30), "par", F.date_format("snapshot_date", "yyyy-MM-dd"), F.col("v"))]
    for name, daily, column in (("roll", k2_roll_rate_daily, "roll_rate"), ("cure", k3_cure_rate_daily, "cure_rate")):
        mean = daily(spark, sf_dir).agg(F.round(F.avg(column) * 100, 2).alias("v"))
        out.append(row(mean, "rate", F.lit(name), F.col("v")))
    p = promises(spark, sf_dir)
    kept = F.col("ptp_status") == "Kept"
    out.append(row(p.agg(F.round(100 * ratio(F.count_if(kept), F.count("*")), 2).alias("v")), "rate", F.lit("kept"), F.col("v")))
    top = p.where(kept).groupBy("user_id").agg(F.sum(money(F.col("value"))).cast("double").alias("v")).orderBy(F.col("v").desc(), "user_id").limit(5)
    out.append(row(top, "top", F.col("user_id").cast("string"), F.col("v")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("""with r(role, layer) as (values ('admin', 'bronze'), ('admin', 'silver'), ('admin', 'gold'), ('admin', 'kpi'), ('manager', 'gold'), ('manager', 'kpi'), ('collector', 'gold'), ('analyst', 'silver'), ('analyst', 'gold'), ('analyst', 'kpi'), ('executive', 'kpi')),
n as (select 'bronze' as layer, count(*) as n from events union all select 'silver', count(*) from orders union all select 'gold', count(*) from customer union all select 'kpi', count(distinct ts::date) from events)
select role, layer, n from r join n using (layer)""")
def g3_layer_access(spark, sf_dir):
    """What each role reads of each layer: executives the KPIs alone; a layer that a role has no grant for is not looked at."""
    layers = {"bronze": table(spark, sf_dir, "events"), "silver": table(spark, sf_dir, "orders"), "gold": table(spark, sf_dir, "customer"), "kpi": k2_roll_rate_daily(spark, sf_dir)}
    if not security.allowed("executive", "kpi") or security.allowed("visitor", "kpi"):
        raise ValueError("grants")
    seen = [df.agg(F.count("*").alias("n")).withColumn("layer", F.lit(name)) for name, df in layers.items()]
    roles = {name: [r for r in security.ACCESS if security.allowed(r, name)] for name in layers}
    each = [df.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles[name]]))) for name, df in zip(layers, seen)]
    return reduce(lambda a, b: a.unionByName(b), each).select("role", "layer", "n")


@query("select event_id, ts::date as day from events where ts::date >= date '2024-01-31' - 14")
def g5_retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return tables.expire(e, "day", 14, F.lit("2024-01-31").cast("date"))


@query("""select 'silver_orders' as job, 'DONE' as status, count(*) as n from orders where o_orderstatus = 'F' union all select 'silver_lines', 'DONE', count(*) from lineitem where l_returnflag = 'R'
union all select 'gold_recovery', 'DONE', count(distinct o_orderkey) from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_returnflag = 'R'
union all select 'broken', 'FAILED', null union all select 'after_broken', 'BLOCKED', null union all select 'maintenance', 'DONE', count(distinct o_orderkey) from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_returnflag = 'R'""")
def r1_r2_job_graph(spark, sf_dir):
    """Two silver jobs, a gold one that needs both, upkeep after it; a job that fails blocks what needs it and nothing else."""
    t = {n: tables.Versioned(spark, scratch_path(spark, n)) for n in ("silver_orders", "silver_lines", "gold_recovery")}
    orders, lines = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    gold = lambda: t["silver_orders"].read().join(t["silver_lines"].read(), F.expr("o_orderkey = l_orderkey"), "left_semi")

    def fail():
        raise RuntimeError("source is absent")

    jobs = [
        orchestrate.Job("maintenance", lambda: t["gold_recovery"].compact(["o_orderkey"], 2), ["gold_recovery"]),
        orchestrate.Job("gold_recovery", lambda: t["gold_recovery"].write(gold()), ["silver_orders", "silver_lines"], retries=1),
        orchestrate.Job("silver_orders", lambda: t["silver_orders"].write(orders.select("o_orderkey", "o_custkey"))),
        orchestrate.Job("silver_lines", lambda: t["silver_lines"].write(lines.select("l_orderkey", "l_linenumber"))),
        orchestrate.Job("broken", fail, retries=1),
        orchestrate.Job("after_broken", fail, ["broken"]),
    ]
    held = {"maintenance": "gold_recovery"}
    rows = [(n, o.status, t[held.get(n, n)].read().count() if o.status == "DONE" else None) for n, o in orchestrate.run(jobs).items()]
    return spark.createDataFrame(rows, "job string, status string, n long")


@query("""with e as (select user_id, ts, event_type = 'purchase' as promise, floor(value)::bigint + 1 as amount from events where event_type in ('purchase', 'click')),
s as (select *, count(*) filter (promise) over (partition by user_id order by ts, promise rows unbounded preceding) as seg from e),
c as (select *, sum(case when promise then 0 else amount end) over (partition by user_id, seg order by ts, promise desc rows unbounded preceding) as paid, first_value(amount) over (partition by user_id, seg order by ts, promise desc) as owed from s where seg > 0),
g as (select user_id, seg, max(owed) as owed, min(paid) filter (paid >= owed) as met, max(paid) as paid, min(ts) as made, max(seg) over (partition by user_id) as last from c group by 1, 2),
r as (select *, seg < last or epoch_ms(made + interval 1 day) < epoch_ms((select max(ts) from e) - interval 30 minute) as ended from g)
select user_id, case when met is not null then 'Kept' when paid > 0 then 'Partial' else 'Broken' end as status, count(*) as n, sum(owed)::double as amount, sum(coalesce(met, paid))::double as paid from r where met is not null or ended group by 1, 2""")
def st11_promises(spark, sf_dir):
    """Purchases as promises and clicks as payments, in a stream that keeps one open promise for each user."""
    src, out = scratch_path(spark, "promises"), scratch_path(spark, "kept")
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    kind = F.when(F.col("event_type") == "purchase", "promise").otherwise("payment")
    e = e.select("user_id", kind.alias("kind"), (F.floor("value") + 1).cast("double").alias("amount"), at.alias("event_time"), (at + F.expr("interval 1 day")).alias("due"))
    e.withColumn("user_id", F.col("user_id").cast("string")).write.parquet(src)
    df = streams.track_promises(streams.file_source(spark, src, "user_id string, kind string, amount double, event_time timestamp, due timestamp", "parquet"), key="user_id")
    streams.start(df, streams.append_sink(out), scratch_path(spark, "checkpoint")).awaitTermination()
    held = spark.read.schema(df.schema).parquet(f"{out}/*")
    g = held.groupBy(F.col("user_id").cast("bigint").alias("user_id"), "status").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("paid").alias("paid"))
    return g.select("user_id", "status", "n", "amount", "paid")


_DAYS = 120


@query(f"with d as (select unnest(generate_series(date '2025-01-01', date '2025-01-01' + {_DAYS - 1}, interval 1 day))::date as snapshot_date) select snapshot_date, count(*) as loans, 0 as broken from d, customer group by 1")
def t1_lifecycle(spark, sf_dir):
    """Days of generated loans, one for each customer: buckets grow by one, only a charged-off loan settles, and dpd is of delinquent loans."""
    p = generate.lives(spark, table(spark, sf_dir, "customer").count(), "2025-01-01", _DAYS)
    # A loan's days are one row, in order: the day before needs no shuffle and no sort.
    steps = F.transform("days", lambda d, i: F.struct(d["snapshot_date"].alias("snapshot_date"), d["bucket_index"].alias("bucket_index"), d["dpd"].alias("dpd"), F.get("days", i - 1)["bucket_index"].alias("before")))
    p, b = p.select(F.inline(steps)), F.col("bucket_index")
    wrong = (b - F.col("before") > 1) | ((F.col("before") >= 5) & (b < F.col("before"))) | ((b == 6) & ~F.col("before").isin(5, 6)) | ((b == 0) & (F.col("dpd") > 0))
    return p.groupBy("snapshot_date").agg(F.count("*").alias("loans"), F.count_if(F.coalesce(wrong, F.lit(False))).cast("int").alias("broken"))


@query("select count(*) as payments, 0 as orphan_reversals, 0 as unequal, 0 as early from orders")
def t2_disorder(spark, sf_dir):
    """Orders as payments, with disorder: none is lost, each reversal undoes one that exists, and late ones land later."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("payment_id"), money(F.col("o_totalprice")).alias("payment_amount"), F.col("o_orderdate").cast("timestamp").alias("effective_date"))
    m = generate.messy(o)
    back = m.where("is_reversal_flag").select("original_payment_id", F.col("payment_amount").alias("undone"))
    own = m.where("not is_reversal_flag").groupBy("payment_id").agg(F.max("payment_amount").alias("amount"), F.count_if(F.col("is_late_arrival") == (F.col("ingestion_date") <= F.col("effective_date"))).alias("early"))
    j = own.join(back, F.col("payment_id") == F.col("original_payment_id"), "full")
    zero = lambda c: F.count_if(c).cast("int")
    return j.agg(
        F.count("payment_id").alias("payments"),
        zero(F.col("payment_id").isNull()).alias("orphan_reversals"),
        zero(F.col("undone") + F.col("amount") != 0).alias("unequal"),
        zero(F.col("early") > 0).alias("early"),
    )


@query("select * from (values ('contacts', 0), ('promises', 0)) t(item, broken)")
def t3_contacts(spark, sf_dir):
    """Contacts and promises of generated loans, and how many break a rule (none may)."""
    n = table(spark, sf_dir, "customer").count()
    days = generate.portfolio(spark, n, "2025-01-01", _DAYS)
    c = materialize(generate.contacts(days), "contacts")
    team = F.broadcast(generate.collectors(spark).select("collector_id", "team_name"))
    # Contacts belong to delinquent days, so only these are looked up; one that has none breaks the rule. Sizes of generated rows
    # are not known before they are made: no such side is broadcast.
    due = days.where(F.col("bucket_index").between(1, 5)).select("loan_id", F.col("snapshot_date").alias("contact_date"), "bucket_index")
    called = c.join(due.hint("merge"), ["loan_id", "contact_date"], "left").join(team, "collector_id", "left")
    own = F.element_at(F.array(*[F.lit(t) for t in generate.TEAMS]), F.col("bucket_index"))
    live = F.col("channel_code") == "OUTBOUND_CALL"
    wrong = (live != F.col("call_duration_seconds").isNotNull()) | (live & ~F.col("team_name").eqNullSafe(own)) | ~F.col("bucket_index").between(1, 5)
    p = generate.promises_to_pay(c).join(c.select("contact_id", "contact_outcome").hint("merge"), "contact_id", "left")
    status, paid, owed = F.col("ptp_status"), F.col("amount_paid_against_ptp"), F.col("ptp_amount")
    fits = F.when(status == "Kept", paid == owed).when(status == "Partial", (paid > 0) & (paid < owed)).otherwise(paid == 0)
    bad = ~fits | (F.col("contact_outcome") != "Right Party Contact") | (F.col("ptp_promised_date") < F.col("ptp_created_date"))
    items = [df.agg(F.count_if(F.coalesce(w, F.lit(True))).cast("int").alias("broken")).select(F.lit(name).alias("item"), "broken") for name, df, w in (("contacts", called, wrong), ("promises", p, bad))]
    return items[0].unionByName(items[1])


@query("with m as (select unnest(generate_series(date '2025-01-03', date '2025-06-03', interval 1 month))::date as file_date) select file_date, count(*) as n, sum(c_custkey)::bigint as ids, 0 as broken from m, customer where file_date <> date '2025-03-03' group by 1")
def t4_bureau(spark, sf_dir):
    """Monthly scores of all customers but in the month of the outage; late ones come 7 to 14 days after, and the band fits the score."""
    codes = F.array(*[F.lit(b[0]) for b in generate.BANDS])
    key = F.col("c_custkey")
    of = table(spark, sf_dir, "customer").select(key.cast("string").alias("customer_id"), key.alias("loan_id"), F.element_at(codes, (key % 7 + 1).cast("int")).alias("risk_band_code"))
    b = generate.bureau(of, "2025-01-01", "2025-06-30", ["2025-03-03"])
    days = F.datediff("source_updated_at", "file_date")
    low, high = (F.create_map(*[F.lit(x) for r in generate.BANDS for x in (r[0], r[k])])[F.col("risk_band_code")] for k in (1, 2))
    wrong = F.when(F.col("is_late_arrival"), ~days.between(7, 14)).otherwise(days != 0) | ~F.col("fico_score").between(low, high)
    return b.groupBy("file_date").agg(F.count("*").alias("n"), F.sum(F.col("customer_id").cast("bigint")).alias("ids"), F.count_if(F.coalesce(wrong, F.lit(True))).cast("int").alias("broken"))


@query("select count(*) as loans, round(count(*) / 0.92)::bigint as applications, count(*) as primary_customers, 0 as orphans from customer")
def t5_entities(spark, sf_dir):
    """Loans, their applications and the bridge to customers."""
    n = table(spark, sf_dir, "customer").count()
    of = generate.loans(spark, n)
    a, bridge = generate.applications(spark, n), generate.loan_customers(of)
    lost = quality.orphans(bridge, "loan_id", of, "loan_id").agg(F.count("*").cast("int").alias("orphans"))
    counts = (of.agg(F.count("*").alias("loans")), a.agg(F.count("*").alias("applications")), bridge.agg(F.count_if(F.col("role") == "Primary").alias("primary_customers")), lost)
    # Four rows of one total each, side by side.
    return reduce(lambda x, y: x.crossJoin(y), counts)
