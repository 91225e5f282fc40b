"""Projections, predicates, aggregates, sorts and scalar functions (PF, A, O, S, F, SRC) on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import date_key, money, rag, ratio, total
from tarnlake.operators import merge, quality
from tarnlake.plans.common import PTP, SNAP, flagged, promises, snapshots, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("select c_custkey::varchar as customer_id, c_name as full_name, cast(c_acctbal as decimal(18,2))::double as balance from customer")
def pf1_staging_projection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("full_name"), money(F.col("c_acctbal")).cast("double").alias("balance"))


@query("select * exclude (p_retailprice, p_size) from part")
def pf2_all_but(spark, sf_dir):
    return table(spark, sf_dir, "part").drop("p_retailprice", "p_size")


@query("select l_orderkey, sum(l_linenumber)::bigint as lines, count(*) as n, round(sum(l_linenumber)::bigint / count(*), 6) as mean from lineitem group by 1")
def pf3_lateral_alias(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lines")
    return spark.sql("select l_orderkey, sum(l_linenumber) as lines, count(*) as n, round(lines / n, 6) as mean from _lines group by l_orderkey")


@query("select count(*) as changed from customer c join supplier s on c_custkey = s_suppkey where c_nationkey is distinct from s_nationkey or nullif(c_acctbal < 0, false) is distinct from nullif(s_acctbal < 0, false)")
def pf4_null_safe_change(spark, sf_dir):
    neg = lambda c: F.nullif(F.col(c) < 0, F.lit(False)).alias("neg")
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), neg("c_acctbal")).alias("l")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), neg("s_acctbal")).alias("r")
    return left.join(right, F.col("c_custkey") == F.col("s_suppkey")).where(merge.changed(["nation", "neg"])).agg(F.count("*").alias("changed"))


@query("select count(*) filter (not coalesce(nullif(event_type = 'error', false), false)) as fine, count(*) filter (value between 10 and 40) as mid, count(*) filter (event_type not in ('click', 'view')) as other, count(*) filter (not (nullif(value, 0) > 5)) as low from events")
def pf5_pf11_predicates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flag = F.nullif(F.col("event_type") == "error", F.lit(False))
    return e.agg(F.count_if(~F.coalesce(flag, F.lit(False))).alias("fine"), F.count_if(F.col("value").between(10, 40)).alias("mid"), F.count_if(~F.col("event_type").isin("click", "view")).alias("other"), F.count_if(~(F.nullif(F.col("value"), F.lit(0.0)) > 5)).alias("low"))


@query("select o_orderkey, round(o_totalprice / (select avg(o_totalprice) from orders), 6) as against_mean from orders where o_custkey in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation))")
def pf9_pf10_subqueries(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own = c.join(F.broadcast(n.agg(F.min("n_name").alias("least"))), F.col("n_name") == F.col("least"), "left_semi").select("c_custkey")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    return o.join(own, o.o_custkey == own.c_custkey, "left_semi").join(F.broadcast(mean), how="cross").select("o_orderkey", F.round(F.col("o_totalprice") / F.col("mean"), 6).alias("against_mean"))


@query("with a as (select o_custkey, count(*) as n from orders group by 1), b as (select n, count(*) as customers from a group by 1) select n, customers, sum(customers) over (order by n)::bigint as up_to from b")
def pf12_chained_steps(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = a.groupBy("n").agg(F.count("*").alias("customers"))
    return b.withColumn("up_to", F.sum("customers").over(Window.orderBy("n")))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-03-02'")
def pf13_batch_date(spark, sf_dir):
    """A range on the raw column reaches the scan; a cast of the column would not."""
    ts = lambda d: F.lit(d).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= ts("1996-03-01")) & (F.col("o_orderdate") < ts("1996-03-02"))).select("o_orderkey")


@query("select l_returnflag, count(*) filter (l_linestatus = 'O') as open_lines, sum(case when l_discount > 0.05 then 1 else 0 end)::bigint as discounted, round(sum(case when l_discount > 0.05 then 1 else 0 end) / nullif(count(*), 0), 6) as share from lineitem group by 1")
def a2_a7_conditional(spark, sf_dir):
    big = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.sum(big).alias("discounted"), F.round(ratio(F.sum(big), F.count("*")), 6).alias("share"))


@query("select l_suppkey, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts from lineitem group by 1")
def a4_two_distincts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("select user_id, min(case when event_type = 'error' then ts end) as first_error, bool_or(event_type = 'purchase') as buyer from events group by 1")
def a5_a6_flags(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("first_error"), F.bool_or(F.col("event_type") == "purchase").alias("buyer"))


@query("select count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount from lineitem")
def a8_global(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), total(F.col("l_extendedprice")).alias("amount"))


@query("select count(*) as keys from (select distinct l_orderkey, l_linenumber from lineitem)")
def a10_distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().agg(F.count("*").alias("keys"))


@query("select l_returnflag, l_linenumber, count(*) as n, true as within from lineitem group by 1, 2")
def a12_approximate_quantile(spark, sf_dir):
    """Approximate medians by group, and whether their exact rank is within a hundredth of the middle."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    g = li.groupBy("l_returnflag", "l_linenumber").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("a"))
    ranks = li.join(F.broadcast(g), ["l_returnflag", "l_linenumber"]).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") < F.col("a")).alias("below"), F.count_if(F.col("l_extendedprice") <= F.col("a")).alias("upto"))
    within = (F.col("below") / F.col("n") <= 0.51 + 1 / F.col("n")) & (F.col("upto") / F.col("n") >= 0.49 - 1 / F.col("n"))
    return ranks.select("l_returnflag", "l_linenumber", "n", within.alias("within"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def a13_positional(spark, sf_dir):
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n from {lines} group by 1, 2", lines=table(spark, sf_dir, "lineitem"))


@query(f"with {SNAP}, r as (select snapshot_date, count(*) filter (roll_flag) / nullif(count(*) filter (bucket_index > 0), 0) as rate from flags group by 1) select round(avg(rate), 4) as mean_rate from r")
def a15_mean_of_rates(spark, sf_dir):
    g = flagged(spark, sf_dir).groupBy("snapshot_date").agg(ratio(F.count_if("roll_flag"), F.count_if(F.col("bucket_index") > 0)).alias("rate"))
    return g.agg(F.round(F.avg("rate"), 4).alias("mean_rate"))


@query("select event_type, max(ts) as latest, date_diff('day', max(ts), timestamp '2024-03-01') as age from events group by 1")
def a17_freshness(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("latest")).withColumn("age", F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("latest")).cast("long"))


@query("select p_brand, p_size, p_partkey from part order by p_brand, p_size desc, p_partkey")
def o1_mixed_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey").orderBy("p_brand", F.col("p_size").desc(), "p_partkey")


@query(f"with {SNAP} select * from (select snapshot_date, cast(sum(balance) as double) as balance from snap group by 1 order by 1 desc limit 7) order by 1")
def o3_latest_ascending(spark, sf_dir):
    g = snapshots(spark, sf_dir).groupBy("snapshot_date").agg(total(F.col("balance")).alias("balance"))
    return g.orderBy(F.col("snapshot_date").desc()).limit(7).orderBy("snapshot_date")


@query("select max_by(event_id, (ts, event_id)) as last_event, max(ts) as ts from events")
def o4_latest_row(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("ts"))


@query("select distinct c_mktsegment, c_nationkey from customer")
def s3_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def s4_keep_last(spark, sf_dir):
    return merge.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("select event_id, coalesce(case when event_type = 'click' then user_id end, event_id) as ref_id, nullif(event_type, 'view') as kind from events")
def f2_f4_coalesce_nullif(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_type") == "click", F.col("user_id")), F.col("event_id")).alias("ref_id"), F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d')::int as date_sk, day(o_orderdate) as d, dayofyear(o_orderdate) as doy, week(o_orderdate) as w, month(o_orderdate) as m, quarter(o_orderdate) as q, year(o_orderdate) as y, dayname(o_orderdate) as day_name, monthname(o_orderdate) as month_name, dayofweek(o_orderdate) in (0, 6) as weekend, last_day(o_orderdate::date) as month_end from orders")
def f5_f8_date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    part = {"d": F.dayofmonth, "doy": F.dayofyear, "w": F.weekofyear, "m": F.month, "q": F.quarter, "y": F.year}
    return table(spark, sf_dir, "orders").select("o_orderkey", date_key(d).alias("date_sk"), *[f(d).cast("long").alias(n) for n, f in part.items()], F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"), F.dayofweek(d).isin(1, 7).alias("weekend"), F.last_day(d).alias("month_end"))


@query("select event_id, ts + (event_id % 86400) * interval 1 second as shifted, ts - interval 30 minutes as cutoff, date_trunc('year', ts)::date as year_start from events")
def f10_f15_intervals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("ts + make_dt_interval(0, 0, 0, event_id % 86400)").alias("shifted"), F.expr("ts - interval 30 minutes").alias("cutoff"), F.trunc("ts", "YEAR").alias("year_start"))


@query("select event_id, try_cast(round_even(value, 0) as int) as whole, event_type = 'click' as flag, try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as digits, split_part(event_type, 'i', 1) as head, concat('***@', event_type) as masked, regexp_replace(event_type, '^.{2}', '**') as hidden from events")
def f11_f14_casts_and_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.bround("value").try_cast("int").alias("whole"), (F.col("event_type") == "click").alias("flag"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint").alias("digits"), F.split_part(F.col("event_type"), F.lit("i"), F.lit(1)).alias("head"), F.concat(F.lit("***@"), "event_type").alias("masked"), F.regexp_replace("event_type", "^.{2}", "**").alias("hidden"))


@query("select p_partkey, 1.0::double as same, round(2.0 * length(p_name) / (2 * length(p_name) + 1), 6)::double as longer, round(2.0 * floor(length(p_name) / 2) / (length(p_name) + floor(length(p_name) / 2)), 6)::double as half, 0.0::double as other, null::double as absent from part")
def f16_similarity(spark, sf_dir):
    """Names against themselves in capitals and spaces, with a letter more, their first half, letters that they lack, and nothing."""
    from tarnlake.operators.identity import name_similarity

    p = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", " ", "_").alias("p_name"))
    n, half = F.col("p_name"), F.substring("p_name", F.lit(1), F.floor(F.length("p_name") / 2).cast("int"))
    forms = {"same": F.concat(F.lit(" "), F.upper(n)), "longer": F.concat(n, F.lit("\u00a7")), "half": half, "other": F.lit("\u00a7\u00a7\u00a7"), "absent": F.lit(None).cast("string")}
    return p.select("p_partkey", *[F.round(name_similarity(n, c), 6).alias(k) for k, c in forms.items()])


@query("select c_custkey, round(abs(c_acctbal - 5000) / 5000, 6) as off from customer")
def f17_percent_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.abs(F.col("c_acctbal") - 5000) / 5000, 6).alias("off"))


@query("select event_id, event_type as kind, user_id::varchar as owner from events")
def f22_details_map(spark, sf_dir):
    from tarnlake.functions.columns import parse_details

    d = table(spark, sf_dir, "events").select("event_id", parse_details(F.concat(F.lit("kind="), "event_type", F.lit(";owner="), "user_id")).alias("m"))
    return d.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["owner"].alias("owner"))


@query("select n_name, case when share >= 0.1 then 'Red' when share >= 0.07 then 'Amber' when share is not null then 'Green' end as colour from (select n_name, count(*) filter (c_acctbal < 0) / nullif(count(c_custkey), 0) as share from nation left join customer on c_nationkey = n_nationkey group by 1)")
def f25_threshold_colour(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    g = n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(ratio(F.count_if(F.col("c_acctbal") < 0), F.count("c_custkey")).alias("share"))
    return g.select("n_name", rag(F.col("share"), 0.1, 0.07).alias("colour"))


@query(f"with {PTP} select ptp_status, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as promised from ptp group by 1")
def b6_promise_funnel(spark, sf_dir):
    return promises(spark, sf_dir).groupBy("ptp_status").agg(F.count("*").alias("n"), total(F.col("value")).alias("promised"))


@query("select p_brand, count(*) filter (l_returnflag = 'R') as flagged, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1")
def b7_flagged_by_band(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("flagged"), F.count("*").alias("n"))


@query("select user_id, round(cast(coalesce(sum(cast(value as decimal(18,2))) filter (event_type = 'purchase'), 0) as double) / nullif(count(*) filter (event_type = 'click'), 0), 4) as kept_per_contact from events group by 1")
def m6_kept_per_contact(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(total(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("kept"), F.count_if(F.col("event_type") == "click").alias("contacts"))
    return g.select("user_id", F.round(ratio(F.col("kept"), F.col("contacts")), 4).alias("kept_per_contact"))


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and floor(a.s_acctbal / 1000) = floor(b.s_acctbal / 1000) and a.s_suppkey < b.s_suppkey")
def j16_blocked_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("step"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("""select list_extract(['OUTBOUND_CALL', 'INBOUND_CALL', 'SMS', 'EMAIL', 'IVR', 'LETTER', 'MOBILE_PUSH', 'ACH', 'BRANCH', 'DEBIT_CARD', 'CHECK', 'WIRE', 'CASH'], (user_id % 13)::int + 1) as channel_code,
case when user_id % 13 in (0, 1, 8, 12) then 'Live Agent' when user_id % 13 in (2, 3, 4) then 'Automated' when user_id % 13 in (5, 10) then 'Written' else 'Digital Self-Serve' end as channel_category,
user_id % 13 in (2, 3, 6, 7, 9, 11) as is_digital_flag, user_id % 13 in (0, 2, 3, 4, 5, 6) as is_outbound_flag, count(*) as events from events group by 1, 2, 3, 4""")
def src12_seeds(spark, sf_dir):
    """Every channel of the reference table with the events that came by it."""
    from tarnlake.sources.landing import channel_dim

    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 13 + 1).cast("int").alias("channel_sk")).agg(F.count("*").alias("events"))
    return channel_dim(spark).join(e, "channel_sk").select("channel_code", "channel_category", "is_digital_flag", "is_outbound_flag", "events")


@query("""select case when score >= 780 then 'R1' when score >= 740 then 'R2' when score >= 700 then 'R3' when score >= 660 then 'R4' when score >= 620 then 'R5' when score >= 580 then 'R6' else 'R7' end as risk_band_code,
count(*) as customers, min(score) as least, max(score) as most from (select 300 + c_custkey * 37 % 551 as score from customer) group by 1""")
def src12_risk_bands(spark, sf_dir):
    """Customers by the band that holds their score."""
    from tarnlake.sources.landing import risk_band_dim

    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 37 % 551 + 300).alias("score"))
    b = F.broadcast(risk_band_dim(spark))
    return c.join(b, F.col("score").between(F.col("score_range_low"), F.col("score_range_high"))).groupBy("risk_band_code").agg(F.count("*").alias("customers"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("select n_nationkey, n_name, null::varchar as n_comment from nation")
def src14_match_by_name(spark, sf_dir):
    from tarnlake.sources.landing import read_by_name

    return read_by_name(spark, f"{sf_dir}/nation.parquet", ["N_NATIONKEY", "N_Name", "n_comment"]).select(F.col("N_NATIONKEY").alias("n_nationkey"), F.col("N_Name").alias("n_name"), F.col("n_comment").cast("string").alias("n_comment"))


@query("select max(ts) as mark, count(*) filter (ts > timestamp '2024-01-20') as beyond from events")
def src17_high_water(spark, sf_dir):
    import datetime

    from tarnlake.sources.ingest import since

    e = table(spark, sf_dir, "events").select("ts")
    beyond = since(e, "ts", datetime.datetime(2024, 1, 20)).agg(F.count("*").alias("beyond"))
    return e.agg(F.max("ts").alias("mark")).join(beyond, how="cross")


@query("select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then 'quarantine' else 'clean' end as target from orders")
def snk2_split(spark, sf_dir):
    bad = F.col("o_orderstatus") == "P"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return o.where(~bad).withColumn("target", F.lit("clean")).unionByName(o.where(bad).withColumn("target", F.lit("quarantine")))


_DQ = {
    "dq1_completeness": ("completeness", "select count(*) filter (c_name is null) as failed, count(*) as total from customer", "customer", {"column": "c_name"}),
    "dq2_uniqueness": ("uniqueness", "select count(*) - count(distinct o_orderkey) as failed, count(*) as total from orders", "orders", {"columns": ["o_orderkey"]}),
    "dq5_negative_values": ("non_negative", "select count(*) filter (c_acctbal < 0 and c_nationkey > 5) as failed, count(*) as total from customer", "customer", {"column": "c_acctbal", "condition": "c_nationkey > 5"}),
    "dq6_accepted_values": ("accepted", "select count(*) filter (l_returnflag not in ('A', 'N')) as failed, count(*) as total from lineitem", "lineitem", {"column": "l_returnflag", "values": ["A", "N"]}),
    "dq7_business_rule": ("rule", "select count(*) filter (not (l_discount <= l_tax + 0.05)) as failed, count(*) as total from lineitem", "lineitem", {"condition": "l_discount <= l_tax + 0.05"}),
}


def _dq(name: str, kind: str, source: str, options: dict):
    def run(spark, sf_dir):
        c = quality.Check(source, name, kind, **options)
        failed, n, _ = quality.single_pass(table(spark, sf_dir, source), [c])[name]
        return spark.createDataFrame([(failed, n)], "failed long, total long")

    run.__name__ = name
    return run


for _name, (_kind, _sql, _source, _options) in _DQ.items():
    query(_sql)(_dq(_name, _kind, _source, _options))


@query("select count(*) as orphans from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 10 <> 0)")
def dq3_relationship(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0")
    return quality.orphans(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", s, "s_suppkey").agg(F.count("*").alias("orphans"))
