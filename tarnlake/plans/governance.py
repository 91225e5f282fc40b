"""Data quality, masking, row filters and entity resolution (DQ, G, ER) on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import quality, quantiles, security
from tarnlake.operators.quality import Check
from tarnlake.plans.common import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CHECKS = [
    Check("customer", "name_complete", "completeness", column="c_name"),
    Check("customer", "key_unique", "uniqueness", columns=["c_custkey"]),
    Check("customer", "balance_not_negative", "non_negative", column="c_acctbal", severity="WARN"),
    Check("orders", "status_known", "accepted", column="o_orderstatus", values=["F", "O"], severity="WARN"),
    Check("orders", "price_rule", "rule", condition="o_totalprice > 1000"),
    Check("lineitem", "line_unique", "uniqueness", columns=["l_orderkey", "l_linenumber"]),
    Check("lineitem", "order_exists", "relationship", column="l_orderkey", parent="orders", parent_column="o_orderkey"),
    Check("lineitem", "price_outliers", "outliers", column="l_extendedprice", severity="INFO"),
]


@query("""
select 'name_complete' as check_name, count(*) filter (c_name is null) as failed_count, count(*) as total_count from customer
union all select 'key_unique', count(*) - count(distinct c_custkey), count(*) from customer
union all select 'balance_not_negative', count(*) filter (c_acctbal < 0), count(*) from customer
union all select 'status_known', count(*) filter (o_orderstatus not in ('F', 'O')), count(*) from orders
union all select 'price_rule', count(*) filter (not (o_totalprice > 1000)), count(*) from orders
union all select 'line_unique', count(*) - count(distinct (l_orderkey, l_linenumber)), count(*) from lineitem
union all select 'order_exists', count(*) filter (o_orderkey is null), count(*) from lineitem left join orders on o_orderkey = l_orderkey
union all select 'price_outliers', count(*) filter (l_extendedprice < q1 - 3 * (q3 - q1) or l_extendedprice > q3 + 3 * (q3 - q1)), count(*) from lineitem, (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)""")
def dq11_rule_run(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    return quality.run_checks(tables, CHECKS, spark).select("check_name", "failed_count", "total_count")


@query("select o_orderpriority, count(*) as n, count(*) / sum(count(*)) over () as share from orders group by 1")
def a14_frequencies(spark, sf_dir):
    return quality.frequencies(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def a9_duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


@query("select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem")
def a11_quartiles(spark, sf_dir):
    q = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem").select("l_extendedprice"), [], "l_extendedprice", [0.25, 0.75])
    return q.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.75, "q3"))])


@query("select l_returnflag, count(*) as n, sum(l_linenumber)::bigint as total, round(avg(l_linenumber), 6) as mean, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, bool_or(l_discount > 0.09) as any_large from lineitem group by 1")
def a1_a5_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.round(F.avg("l_linenumber"), 6).alias("mean"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.bool_or(F.col("l_discount") > 0.09).alias("any_large"))


@query("select o_custkey, list_sort(list(o_orderkey)) as orders, max_by(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by 1")
def a16_collect(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("select c_custkey, '*******' || substr('555-010-' || lpad(c_custkey::varchar, 4, '0'), 8) as phone, '***@example.com' as email, '****' as ssn, make_date(1950 + (c_custkey % 50)::int, 1, 1) as dob from customer")
def g2_masks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("555-010-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("phone"), F.concat(F.lit("u"), "c_custkey", F.lit("@example.com")).alias("email"), F.lpad(F.col("c_custkey").cast("string"), 4, "0").alias("ssn"),
        F.make_date((1950 + F.col("c_custkey") % 50).cast("int"), F.lit(6), F.lit(15)).alias("dob"),
    )
    return security.masked(c, {"phone": "phone", "email": "email", "ssn": "ssn", "dob": "dob"}, security.ANALYST)


@query("select c_custkey, c_nationkey from customer where c_nationkey = 3 union all select c_custkey, -1 from customer where c_nationkey in (3, 8)")
def g1_row_filter(spark, sf_dir):
    """What a collector sees, and what their manager does."""
    users = spark.createDataFrame([("ana", 3, "north"), ("bo", 8, "north"), ("kim", 5, "south")], "username string, collector_id int, team_name string")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    teams = users.select(F.col("collector_id").alias("_id"), F.col("team_name").alias("team"))
    with_team = c.join(F.broadcast(teams), F.col("c_nationkey") == F.col("_id"), "left")
    own = security.row_filter(c, users, "ana", security.COLLECTOR, "c_nationkey")
    managed = security.row_filter(with_team, users, "ana", security.MANAGER, "c_nationkey", "team")
    return own.unionByName(managed.select("c_custkey", F.lit(-1).alias("c_nationkey")))


@query("select o_orderkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def g4_propagated_filter(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    return security.propagate(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice"), dim, "o_custkey", "c_custkey", hide=["o_totalprice", "o_custkey"])


@query("select item, value from (values ('rows:customer', (select count(*) from customer)), ('rows:orders', (select count(*) from orders)), ('orphans:orders.o_custkey', (select count(*) from orders where o_custkey not in (select c_custkey from customer)))) t(item, value)")
def dq13_health(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return quality.health(t, {}, [("orders", "o_custkey", "customer", "c_custkey")], spark).select("item", "value")


@query("select c_custkey * 3 as golden, 3 - (c_custkey % 5 = 0)::int as records, c_name as last_name, c_mktsegment as first_name, case when c_custkey % 5 <> 0 then 'bureau' else 'servicing' end as rating from customer")
def er1_er4_identity(spark, sf_dir):
    """Each customer in three systems: as they are, with a slip in the last name, and without the number. One record survives,
    with every value from the best system that has it."""
    from tarnlake.operators.identity import resolve, survive

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    dob, number = F.date_add(F.lit("1900-01-01").cast("date"), F.col("c_custkey").cast("int")).cast("string"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    record = lambda k, source, last, ssn, rating: c.select((F.col("c_custkey") * 3 + k).alias("id"), F.lit(source).alias("source"), F.col("c_mktsegment").alias("first_name"), last.alias("last_name"), dob.alias("dob"), ssn.alias("ssn_last4"), rating.alias("rating"))
    none = F.lit(None).cast("string")
    crm, slip = record(0, "CRM", F.col("c_name"), number, none), record(1, "SERVICING", F.concat("c_name", F.lit("x")), number, F.lit("servicing"))
    bureau = record(2, "BUREAU", F.upper("c_name"), none, F.lit("bureau")).where("id % 15 <> 2")
    golden = survive(resolve(crm.unionByName(slip).unionByName(bureau)), ["last_name", "first_name", "rating"], {"CRM": 1, "BUREAU": 2, "SERVICING": 3})
    return golden.select(F.col("golden_id").alias("golden"), F.col("records").cast("int").alias("records"), "last_name", "first_name", "rating")
