"""Ingestion, sinks, streams and table upkeep (SRC, SNK, DML, ST, DQ, X) as queries.

Each query lands the test tables in the shared scratch folder in the form that its operator reads, runs the operator on all of
it, and returns what the operator left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import money, total
from tarnlake.operators import buckets, merge, quality, tables, temporal, views
from tarnlake.plans.common import SNAP, flagged, table
from tarnlake.session import materialize, scratch_path
from tarnlake.sources import ingest, landing
from tarnlake.sources.contracts import Contract
from tarnlake.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(18,2)"}
_YEAR = "strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')"


def _orders(spark, sf_dir: str) -> DataFrame:
    """Orders with the first day of their year as the landing date."""
    return table(spark, sf_dir, "orders").withColumn("day", F.trunc("o_orderdate", "year")).select(*_ORDER_TYPES, "day")


def _landed_orders(spark, sf_dir: str) -> tuple[Contract, list[str]]:
    """The contract of orders landed as CSV by date, and the dates."""
    path, o = scratch_path(spark, "landed"), _orders(spark, sf_dir)
    landing.write_dated(o, path, "day", {"0000": {"drop": ["day"]}})
    dates = [str(r.day) for r in o.select("day").distinct().orderBy("day").collect()]
    return Contract("orders", f"{path}/dt={{date}}", dict(_ORDER_TYPES), ["o_orderkey"]), dates


@query(f"select {_YEAR} as dt, o_orderkey, o_custkey, o_orderstatus, cast(cast(o_totalprice as decimal(18,2)) as double) as price from orders")
def src1_csv_partitions(spark, sf_dir):
    """CSV with a header, one date partition after another, under the contract's types."""
    contract, dates = _landed_orders(spark, sf_dir)
    out = None
    for d in dates:
        part = ingest.conform(landing.read_partition(spark, contract, d), contract, {}).select(F.lit(d).alias("dt"), "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select event_id, user_id, event_type, cast(cast(value as decimal(18,2)) as double) as value from events")
def src2_json_landing(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", money(F.col("value")).alias("value")).write.json(f"{path}/dt=2024-01-01")
    contract = Contract("events", f"{path}/dt={{date}}", {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}, ["event_id"], file_format="json")
    return ingest.conform(landing.read_partition(spark, contract, "2024-01-01"), contract, {}).select("event_id", "user_id", "event_type", "value")


@query("select n_nationkey, n_name, n_regionkey, 2 as loads from nation")
def src3_full_snapshot(spark, sf_dir):
    """A whole file replaces the table, however often it is loaded."""
    path, bronze, side, log = (scratch_path(spark, n) for n in ("snapshot", "bronze", "quarantine", "log"))
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    contract = Contract("nation", path, {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, ["n_nationkey"], strategy="full_snapshot_overwrite")
    for day in ("2025-01-01", "2025-01-02"):
        ingest.ingest(spark, contract, day, bronze, side, log)
    return spark.read.parquet(f"{bronze}/nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(spark.read.parquet(log).count()).cast("int").alias("loads"))


def _customer_files(spark, sf_dir: str) -> tuple[str, Contract]:
    """Customers as CSV under three headers: as promised, with a column more in another order, and with a column renamed."""
    path = scratch_path(spark, "headers")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    plain = c.where("c_nationkey < 8").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    more = c.where("c_nationkey between 8 and 15").select("c_name", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    named = c.where("c_nationkey > 15").select(F.col("c_custkey").alias("customer_id"), "c_name", "c_nationkey", "c_acctbal")
    for k, part in enumerate((plain, more, named)):
        part.repartition(2).write.option("header", True).csv(f"{path}/dt=2025-01-0{k + 1}")
    return path, Contract("customer", path, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"}, ["c_custkey"], renames={"customer_id": "c_custkey"})


def _files(spark, path: str) -> list[str]:
    return [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path").collect()]


@query("select c_custkey, c_name, c_acctbal, case when c_nationkey between 8 and 15 then c_mktsegment end as c_mktsegment, make_date(2025, 1, case when c_nationkey < 8 then 1 when c_nationkey < 16 then 2 else 3 end) as dt from customer")
def src4_src5_glob_union(spark, sf_dir):
    """Files of several headers as one table by name, with the date of their folder."""
    path, contract = _customer_files(spark, sf_dir)
    df = landing.read_glob(spark, _files(spark, path), contract.renames).withColumn("day", landing.partition_date())
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment", F.col("day").alias("dt"))


@query("select case when c_nationkey < 8 then 'none' when c_nationkey < 16 then 'additive' else 'none' end as kind, case when c_nationkey between 8 and 15 then 'c_mktsegment' else '' end as added, case when c_nationkey > 15 then 'customer_id>c_custkey' else '' end as renamed, count(*) as n from customer group by 1, 2, 3")
def dq17_drift_report(spark, sf_dir):
    """The drift class of every landed file, with the rows that it concerns."""
    path, contract = _customer_files(spark, sf_dir)
    files = _files(spark, path)
    report = ingest.drift_report(spark, contract, files).select(F.col("path").alias("source_file"), "kind", F.array_join("added", ",").alias("added"), F.array_join("renamed", ",").alias("renamed"))
    n = landing.read_glob(spark, files, contract.renames).groupBy("source_file").agg(F.count("*").alias("rows"))
    return n.join(report, "source_file").groupBy("kind", "added", "renamed").agg(F.sum("rows").alias("n"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, typeof(c_acctbal) = 'DOUBLE' as inferred from customer")
def src6_inferred_types(spark, sf_dir):
    path = scratch_path(spark, "inferred")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    df = landing.read_inferred(spark, path)
    kinds = dict(df.dtypes)
    ok = kinds["c_custkey"] in ("int", "bigint") and kinds["c_acctbal"] == "double" and kinds["c_name"] == "string"
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", F.lit(ok).alias("inferred"))


@query("select column_index as place, column_name as name from duckdb_columns() where table_name = 'orders' and column_name in ('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice')")
def src7_header(spark, sf_dir):
    contract, dates = _landed_orders(spark, sf_dir)
    names = landing.header(spark, contract.path.format(date=dates[0]))
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place int, name string")


_BY_YEAR = f"select {_YEAR} as day, count(*) filter (o_orderstatus <> 'P') as clean, count(*) filter (o_orderstatus = 'P') as held from orders group by 1"


@query(f"with y as ({_BY_YEAR}) select day, md5('orders|' || day) as batch_id, 'SUCCESS' as status, clean as row_count, held as quarantined_count, clean as bronze_rows, held as quarantine_rows, 2 as runs from y union all select '1901-01-01', md5('orders|1901-01-01'), 'NO_FILE_LANDED', 0, 0, 0, 0, 2")
def snk1_snk2_snk3_ingest(spark, sf_dir):
    """Every landed date twice, and a date on which nothing landed: bronze and quarantine by date, and the control log."""
    contract, dates = _landed_orders(spark, sf_dir)
    bronze, side, log = (scratch_path(spark, n) for n in ("bronze", "quarantine", "log"))
    for _ in range(2):
        for d in [*dates, "1901-01-01"]:
            ingest.ingest(spark, contract, d, bronze, side, log, corrupt=F.col("o_orderstatus") == "P")
    rows = lambda path, name: spark.read.parquet(f"{path}/orders").groupBy("_batch_id").agg(F.count("*").alias(name))
    runs = spark.read.parquet(log).groupBy("batch_id", "status", "row_count", "quarantined_count").agg(F.count("*").cast("int").alias("runs"))
    days = spark.createDataFrame([(d, ingest.batch_id("orders", d)) for d in [*dates, "1901-01-01"]], "day string, batch_id string")
    out = days.join(runs, "batch_id").join(rows(bronze, "b").withColumnRenamed("_batch_id", "batch_id"), "batch_id", "left").join(rows(side, "q").withColumnRenamed("_batch_id", "batch_id"), "batch_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("day", "batch_id", "status", "row_count", "quarantined_count", zero("b").alias("bronze_rows"), zero("q").alias("quarantine_rows"), "runs")


@query("select o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1")
def snk4_snk5_overwrite(spark, sf_dir):
    """A new version with other columns, in folders by a business column, takes the old one's place."""
    t = tables.Versioned(spark, scratch_path(spark, "overwrite"))
    o = table(spark, sf_dir, "orders")
    t.write(o.select("o_orderkey"))
    t.write(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), partition_by=["o_orderstatus"])
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), total(F.col("o_totalprice")).alias("amount"))


_PRIORITY = "select o_orderpriority, count(*) as n from orders"


@query(f"select 'table' as kind, * from ({_PRIORITY} group by 1) union all select 'view', * from ({_PRIORITY} where o_orderstatus = 'F' group by 1) union all select 'kept', * from ({_PRIORITY} where o_orderstatus = 'F' group by 1) union all select 'refreshed', * from ({_PRIORITY} group by 1)")
def snk6_snk7_snk8_views(spark, sf_dir):
    """A table made from a query and made again, a view, and a materialised view that a refresh with the same mark leaves alone."""
    name = scratch_path(spark, "t").rsplit("/", 1)[1].replace("-", "_")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    count = lambda d: d.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    for part in (o.where("o_orderstatus = 'F'"), o):
        views.replace_table(count(part), name, scratch_path(spark, "table"))
    # What the name stands for is read; the name itself goes, its files stay.
    named = materialize(spark.table(name), "named")
    spark.sql(f"DROP TABLE {name}")
    views.replace_view(o.where("o_orderstatus = 'F'"), f"{name}_v")
    held = views.Materialized(tables.Versioned(spark, scratch_path(spark, "view")))
    held.refresh("F", lambda: count(o.where("o_orderstatus = 'F'")))
    held.refresh("F", lambda: count(o))
    kept = held.read()
    held.refresh("all", lambda: count(o))
    parts = {"table": named, "view": count(spark.table(f"{name}_v")), "kept": kept, "refreshed": held.read()}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "o_orderpriority", "n")
        out = part if out is None else out.unionByName(part)
    return out


_CHECKS_SQL = """
select 'negative' as check_name, count(*) filter (c_acctbal < 0) as failed, count(*) as total, 'WARN' as severity, count(*) filter (c_acctbal < 0) > 0 as bad from customer
union all select 'segment', count(*) filter (c_mktsegment is null), count(*), 'FAIL', count(*) filter (c_mktsegment is null) > 0 from customer
union all select 'returned', count(*) filter (l_returnflag not in ('A', 'N')), count(*), 'FAIL', count(*) filter (l_returnflag not in ('A', 'N')) > 0.4 * count(*) from lineitem
union all select 'discount', count(*) filter (not l_discount <= l_tax + 0.05), count(*), 'FAIL', count(*) filter (not l_discount <= l_tax + 0.05) > 0 from lineitem
"""


def _run(spark, sf_dir: str) -> DataFrame:
    q = quality.Check
    checks = [
        q("customer", "negative", "non_negative", column="c_acctbal", severity="WARN"),
        q("customer", "segment", "completeness", column="c_mktsegment"),
        q("lineitem", "returned", "accepted", column="l_returnflag", values=["A", "N"], tolerance=0.4),
        q("lineitem", "discount", "rule", condition="l_discount <= l_tax + 0.05"),
        q("absent", "nothing", "completeness", column="x"),
    ]
    return quality.run_checks({t: table(spark, sf_dir, t) for t in ("customer", "lineitem")}, checks, spark)


@query(f"select check_name, failed as failed_count, total as total_count, 2 as runs from ({_CHECKS_SQL}) union all select 'nothing', 0, 0, 2")
def snk10_results_append(spark, sf_dir):
    path = scratch_path(spark, "results")
    for _ in range(2):
        quality.append_results(_run(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("check_name", "failed_count", "total_count").agg(F.count_distinct("run_id").cast("int").alias("runs"))


@query(f"with r as ({_CHECKS_SQL}), s as (select severity, case when bad then 'FAILED' else 'PASSED' end as status from r union all select 'FAIL', 'SKIPPED') select severity, status, count(*) as checks, (select count(*) filter (bad and severity = 'FAIL') = 0 from r) as gate from s group by 1, 2")
def dq12_summary(spark, sf_dir):
    """The run's checks by severity and status, and whether it lets the load pass."""
    results = _run(spark, sf_dir)
    return quality.summary(results).withColumn("gate", F.lit(quality.gate(results)))


@query("""with n as (select o_orderpriority as p, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as a, count(*) as n, max(o_orderdate)::date as last from orders group by 1),
t as (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) as a, count(*) as n, max(o_orderdate)::date as last from orders)
select 'balance ' || p as check_name, (abs(t.a - 5 * n.a) > 0.02 * 5 * n.a)::int as failed_count from n, t
union all select 'rows ' || p, case when abs(t.n - 5 * n.n) <= 0.02 * 5 * n.n then 0 else greatest(1, abs(t.n - 5 * n.n)) end from n, t
union all select 'fresh ' || p, (date_diff('day', t.last, n.last + 1) > 0)::int from n, t""")
def dq4_dq9_dq10_reconciliation(spark, sf_dir):
    """The whole table against five times each priority's part: balance and rows within 2 %, and as fresh as the part."""
    o = table(spark, sf_dir, "orders")
    parts = o.groupBy("o_orderpriority").agg(total(F.col("o_totalprice")).alias("a"), F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("last")).collect()
    q = quality.Check
    checks = [q("orders", f"balance {r.o_orderpriority}", "balance", column="o_totalprice", control=5 * r.a, tolerance=0.02) for r in parts]
    checks += [q("orders", f"rows {r.o_orderpriority}", "row_count", control=5 * r.n, tolerance=0.02) for r in parts]
    checks += [q("orders", f"fresh {r.o_orderpriority}", "freshness", column="o_orderdate", as_of=str(r["last"] + __import__("datetime").timedelta(days=1)), days=0) for r in parts]
    return quality.run_checks({"orders": o}, checks, spark).select("check_name", "failed_count")


@query("""with b as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
c as (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3 from customer),
p as (select quantile_cont(p_retailprice, 0.25) as q1, quantile_cont(p_retailprice, 0.75) as q3 from part)
select 'events' as table_name, count(*) filter (value < q1 - 3 * (q3 - q1) or value > q3 + 3 * (q3 - q1)) as failed_count, count(*) as total_count from events, b
union all select 'customer', count(*) filter (c_acctbal < q1 - 3 * (q3 - q1) or c_acctbal > q3 + 3 * (q3 - q1)), count(*) from customer, c
union all select 'part', count(*) filter (p_retailprice < q1 - 3 * (q3 - q1) or p_retailprice > q3 + 3 * (q3 - q1)), count(*) from part, p""")
def dq8_outliers(spark, sf_dir):
    columns = {"events": "value", "customer": "c_acctbal", "part": "p_retailprice"}
    checks = [quality.Check(t, f"{t} outliers", "outliers", column=c, severity="INFO") for t, c in columns.items()]
    return quality.run_checks({t: table(spark, sf_dir, t) for t in columns}, checks, spark).select("table_name", "failed_count", "total_count")


@query("""with k as (select o_orderkey from orders where o_orderstatus <> 'P'), j as (select l_returnflag, k.o_orderkey is null as lost from lineitem left join k on k.o_orderkey = l_orderkey)
select 'all' as part, count(*) as total, count(*) filter (lost) as lost, count(*) filter (lost) <= 0.03 * count(*) as passed from j
union all select l_returnflag, count(*), count(*) filter (lost), count(*) filter (lost) <= 0.03 * count(*) from j group by 1""")
def dq15_join_loss(spark, sf_dir):
    """What an inner join of lines with settled orders would lose, of all and by return flag, against 3 %."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    lost = quality.join_loss(li, "l_orderkey", o, "o_orderkey", by="l_returnflag")
    return lost.select(F.coalesce("l_returnflag", F.lit("all")).alias("part"), "total", "lost", "passed")


@query("select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as double) as price, case when o_orderdate >= timestamp '1998-01-01' then 'web' end as origin, case when o_orderdate < timestamp '2000-01-01' then o_orderstatus end as status, year(o_orderdate)::int as yr from orders")
def snk11_dated_csv(spark, sf_dir):
    """CSV by date whose form changes twice: a column more, then a column less and one renamed; read back by name."""
    path = scratch_path(spark, "dated")
    o = table(spark, sf_dir, "orders").select("o_orderkey", money(F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "year").alias("day"))
    changes = {"1998-01-01": {"add": {"origin": "'web'"}, "drop": ["day"]}, "2000-01-01": {"add": {"origin": "'web'"}, "drop": ["status", "day"], "rename": {"price": "amount"}}, "0000": {"drop": ["day"]}}
    landing.write_dated(o, path, "day", changes)
    df = landing.read_glob(spark, _files(spark, path), {"amount": "price"}).withColumn("day", landing.partition_date())
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("price").cast("double").alias("price"), "origin", "status", F.year("day").alias("yr"))


def _day(df: DataFrame, name: str = "at") -> DataFrame:
    return df.withColumn(name, F.col("ts").cast("timestamp"))


_FIRST = "timestamp '2024-01-15'"


@query(f"select (ts >= {_FIRST})::bigint as batch_id, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1")
def src15_auto_ingest(spark, sf_dir):
    """What has landed since the last run, each file once: two landings, two runs and one without news."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    for part in (e.where(F.col("ts") < F.lit("2024-01-15")), e.where(F.col("ts") >= F.lit("2024-01-15")), None):
        if part is not None:
            part.write.mode("append").parquet(src)
        streams.start(landing.incremental_files(spark, src, e.schema), streams.append_sink(out), checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("select event_id::varchar as contact_id, user_id::varchar as customer_id, event_type as channel_code, value::int as call_duration_seconds from events")
def src10_json_body(spark, sf_dir):
    """Bodies of a message stream as columns."""
    src, out = scratch_path(spark, "bodies"), scratch_path(spark, "decoded")
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("contact_id"), F.col("user_id").cast("string").alias("customer_id"), F.col("event_type").alias("channel_code"), F.bround("value").cast("int").alias("call_duration_seconds")))
    _day(e, "ingestion_time").select(body.cast("binary").alias("body"), "ingestion_time").write.parquet(src)
    df = streams.decode(streams.file_source(spark, src, "body binary, ingestion_time timestamp", "parquet"))
    streams.start(df, streams.append_sink(out), scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("contact_id", "customer_id", "channel_code", "call_duration_seconds")


def _contacts(spark, sf_dir: str) -> DataFrame:
    """Events with the time of their arrival: up to an hour later."""
    e = _day(table(spark, sf_dir, "events"), "event_time")
    return e.select(F.concat_ws("-", "user_id", "event_type").alias("contact"), "event_id", "event_type", "event_time", F.expr("event_time + make_interval(0, 0, 0, 0, 0, cast(event_id * 7 % 60 as int), 0)").alias("ingestion_time"))


_LATE = "event_id * 7 % 60 > 30"


@query(f"""with s as (select event_id, user_id || '-' || event_type as contact, ts, {_LATE} as late, ts >= {_FIRST} as later, min(ts >= {_FIRST}) over (partition by user_id, event_type) as only_later from events),
m as (select *, row_number() over (partition by contact order by later, ts desc, event_id desc) as rn from s)
select 'bronze' as sink, late as late_arrival, count(*) as n, sum(event_id)::bigint as ids from s group by 1, 2
union all select 'silver', late, count(*), sum(event_id)::bigint from m where rn = 1 group by 1, 2""")
def st3_st4_st6_two_sinks(spark, sf_dir):
    """Late rows flagged and kept; two sinks with checkpoints of their own, one of all rows and one that merges the latest of
    each new contact and never changes a known one; a replay adds nothing."""
    src, bronze, silver, one, two = (scratch_path(spark, n) for n in ("contacts", "bronze", "silver", "one", "two"))
    c = _contacts(spark, sf_dir)
    kept = buckets.Bucketed(spark, silver, ["contact"], 16)
    for part in (c.where("event_time < '2024-01-15'"), c.where("event_time >= '2024-01-15'"), None):
        if part is not None:
            part.write.mode("append").parquet(src)
        df = streams.flag_late(streams.file_source(spark, src, c.schema, "parquet"))
        streams.start(df, streams.append_sink(bronze), one).awaitTermination()
        streams.start(df, streams.bucket_sink(kept, ["event_time", "event_id"]), two).awaitTermination()
    held = spark.read.parquet(bronze).select(F.lit("bronze").alias("sink"), "late_arrival", "event_id")
    held = held.unionByName(kept.read().select(F.lit("silver").alias("sink"), "late_arrival", "event_id"))
    return held.groupBy("sink", "late_arrival").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def st1_st7_dedup(spark, sf_dir):
    """Events that arrive twice stay once, within the watermark."""
    src, out = scratch_path(spark, "twice"), scratch_path(spark, "once")
    c = _contacts(spark, sf_dir)
    for _ in range(2):
        c.write.mode("append").parquet(src)
    df = streams.dedup(streams.file_source(spark, src, c.schema, "parquet"), ["event_id"])
    streams.start(df, streams.append_sink(out), scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def st2_st8_windows(spark, sf_dir):
    src, out = scratch_path(spark, "hours"), scratch_path(spark, "windows")
    c = _contacts(spark, sf_dir)
    c.write.parquet(src)
    df = streams.windowed(streams.file_source(spark, src, c.schema, "parquet"), ["event_type"], [F.count("*").alias("n")])
    streams.start(df, streams.complete_sink(out), scratch_path(spark, "checkpoint"), mode="complete").awaitTermination()
    return tables.Versioned(spark, out).read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"with b as (select event_id, user_id || '-' || event_type as contact, ts, {_LATE} as late from events), s as (select contact from b where not late), r as (select *, row_number() over (partition by contact order by ts desc, event_id desc) as rn from b where late and contact not in (select contact from s)) select contact, event_id from r where rn = 1")
def st9_reconcile(spark, sf_dir):
    """Late rows whose contact the merged table lacks, the latest of each."""
    c = streams.flag_late(_contacts(spark, sf_dir))
    return streams.reconcile(c, c.where("not late_arrival"), ["contact"], ["event_time", "event_id"]).select("contact", "event_id")


@query(f"select event_id, case when ts >= {_FIRST} then event_type end as event_type from events")
def st10_schema_evolution(spark, sf_dir):
    """A column that the stream gains half way is null in what came before."""
    one, two, out = (scratch_path(spark, n) for n in ("narrow", "wide", "grown"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    narrow, wide = e.where(F.col("ts") < F.lit("2024-01-15")).select("event_id"), e.where(F.col("ts") >= F.lit("2024-01-15")).select("event_id", "event_type")
    for path, part, sink in ((one, narrow, f"{out}/source=1"), (two, wide, f"{out}/source=2")):
        part.write.parquet(path)
        streams.start(streams.file_source(spark, path, part.schema, "parquet"), streams.append_sink(sink), scratch_path(spark, "checkpoint")).awaitTermination()
    return streams.read_appended(spark, out).select("event_id", "event_type")


@query("select user_id, max(ts) as last, round(date_diff('second', max(ts), timestamp '2024-01-31') / 3600.0, 1) as hours from events group by 1 having date_diff('second', max(ts), timestamp '2024-01-31') > 12 * 3600 and epoch(timestamp '2024-01-31') - epoch(max(ts)) > 12 * 3600")
def st12_missing_data(spark, sf_dir):
    """Users that have been silent for over twelve hours at a given time."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return streams.missing_data(e, ["user_id"], "ts", "2024-01-31", 12).select("user_id", "last", F.round("hours_since", 1).alias("hours"))


@query("""with v(version, n) as (values (0, (select count(*) from orders where o_orderstatus = 'F')), (1, (select count(*) from orders)), (2, (select count(*) from orders)), (3, (select count(*) from orders where o_orderstatus = 'F')))
select version, n, version >= 2 as kept from v""")
def x1_x2_x6_versions(spark, sf_dir):
    """Versions of a table: written, clustered into fewer files, restored; old ones are read until they are cleared away."""
    t = tables.Versioned(spark, scratch_path(spark, "versions"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t.write(o.where("o_orderstatus = 'F'"))
    t.write(o)
    t.compact(["o_orderkey", "o_custkey"], 4, zorder=True)
    t.restore(0)
    n = {v: t.read(v).count() for v in t.versions()}
    t.vacuum(2)
    return spark.createDataFrame([(v, c, v in t.versions()) for v, c in n.items()], "version int, n long, kept boolean")


@query("select 'o_orderkey' as col, min(o_orderkey)::varchar as least, max(o_orderkey)::varchar as most, count(*) filter (o_orderkey is null)::varchar as nulls from orders union all select 'o_custkey', min(o_custkey)::varchar, max(o_custkey)::varchar, count(*) filter (o_custkey is null)::varchar from orders")
def x3_statistics(spark, sf_dir):
    name = scratch_path(spark, "t").rsplit("/", 1)[1].replace("-", "_")
    views.replace_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), name, scratch_path(spark, "analysed"))
    tables.analyze(spark, name)
    rows = []
    for c in ("o_orderkey", "o_custkey"):
        held = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name} {c}").collect()}
        rows.append((c, held["min"], held["max"], held["num_nulls"]))
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "col string, least string, most string, nulls string")


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select max(o_custkey) from orders union all select min(o_custkey) from orders)")
def x4_lookup(spark, sf_dir):
    """Rows by key from a table that is clustered by it and has its filter."""
    t = tables.Versioned(spark, scratch_path(spark, "lookup"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t.write(o.repartitionByRange(8, "o_custkey").sortWithinPartitions("o_custkey"), **tables.lookup_options("o_custkey"))
    least, most = o.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    return t.read().where(F.col("o_custkey").isin(least, most))


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as z, min(o_orderdate) over (partition by o_custkey) as d0, max(o_orderdate) over (partition by o_custkey) as d1 from orders),
s as (select o_custkey, o_orderpriority, o_orderdate from r where a = 1), c as (select o_custkey, o_orderpriority, o_orderdate from r where z = 1 and d1 > d0)
select s.o_custkey, s.o_orderpriority, s.o_orderdate as effective_start, case when c.o_orderpriority <> s.o_orderpriority then c.o_orderdate else timestamp '9999-12-31' end as effective_end, coalesce(c.o_orderpriority = s.o_orderpriority, true) as is_current from s left join c using (o_custkey)
union all select o_custkey, o_orderpriority, o_orderdate, timestamp '9999-12-31', true from c""")
def dml1_dml2_two_pass(spark, sf_dir):
    """First orders as open versions, last orders as changes: changed ones close, then every change opens a version."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    w = Window.partitionBy("o_custkey")
    o = o.withColumn("d0", F.min("o_orderdate").over(w)).withColumn("d1", F.max("o_orderdate").over(w))
    first = merge.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    end = merge.end_of_time().cast(dict(o.dtypes)["o_orderdate"])
    state = first.select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("effective_start"), end.alias("effective_end"), F.lit(True).alias("is_current"))
    changes = merge.latest(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).where("d1 > d0").select("o_custkey", "o_orderpriority", "o_orderdate")
    return merge.scd2_two_pass(state, changes, ["o_custkey"], "o_orderdate", ["o_orderpriority"])


@query(f"select event_id, case when value >= 60 then 'Kept' when value >= 30 then 'Partial' else 'Broken' end as ptp_status, cast(cast(value as decimal(18,2)) as double) as amount_paid, case when ts < {_FIRST} then 'first' else 'second' end as loaded from events where event_type = 'purchase'")
def dml8_promise_upsert(spark, sf_dir):
    """Promises that were pending take the status and amount that came later; where they were loaded from stays."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    state = e.where(F.col("ts") < F.lit("2024-01-15")).select("event_id", F.lit("Pending").alias("ptp_status"), F.lit(0.0).alias("amount_paid"), F.lit("first").alias("loaded"))
    status = F.when(F.col("value") >= 60, "Kept").when(F.col("value") >= 30, "Partial").otherwise("Broken")
    changes = e.select("event_id", status.alias("ptp_status"), money(F.col("value")).cast("double").alias("amount_paid"), F.lit("second").alias("loaded"))
    return merge.upsert(state, changes, ["event_id"], update=["ptp_status", "amount_paid"])


@query(f"with {SNAP} select user_id, snapshot_date, bucket_index, coalesce(cure_flag, false) as cure_flag, roll_flag, case when snapshot_date < date '2024-01-15' then 'first' else 'second' end as load from flags")
def dml10_insert_with_flags(spark, sf_dir):
    """Daily states by their composite key with flags that look a day back: days that are held never change."""
    d = flagged(spark, sf_dir).select("user_id", "snapshot_date", "bucket_index", F.coalesce("cure_flag", F.lit(False)).alias("cure_flag"), "roll_flag")
    state = d.where("snapshot_date < date'2024-01-15'").withColumn("load", F.lit("first"))
    return merge.insert_only(state, d.withColumn("load", F.lit("second")), ["user_id", "snapshot_date"])


@query("select o_orderkey, o_orderdate + to_seconds((row_number() over (partition by o_orderdate order by o_orderkey) % 86400)::int) as ingested_at from orders")
def dml15_synthetic_time(spark, sf_dir):
    """A time of arrival from the date and the row's number on it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")) % 86400
    return o.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(secs=n)).alias("ingested_at"))


@query("select p_partkey, p_brand, 'open' as state, case when p_size > 25 then p_retailprice * 2 else p_retailprice end as p_retailprice from part")
def dml16_alter_and_update(spark, sf_dir):
    """A column added, columns dropped, and values set where a condition holds."""
    p = table(spark, sf_dir, "part").withColumn("state", F.lit("open")).drop("p_name", "p_type")
    return p.withColumn("p_retailprice", F.when(F.col("p_size") > 25, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice"))).drop("p_size")


@query("with d as (select o_orderpriority, o_orderdate::date as day, cast(sum(cast(o_totalprice as decimal(18,2))) * 100 as bigint) as v from orders group by 1, 2) select o_orderpriority, day, round(avg(v) over (partition by o_orderpriority order by day range between interval 90 days preceding and current row), 4) as v_90d, round(avg(v) over (partition by o_orderpriority order by day range between interval 365 days preceding and current row), 4) as v_365d from d")
def w7_w8_trailing_year(spark, sf_dir):
    """Averages, in cents, over 90 and 365 days on years of data."""
    d = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg((F.sum(money(F.col("o_totalprice"))) * 100).cast("bigint").alias("v"))
    for days in (90, 365):
        d = temporal.trailing_average(d, F.col("v"), "day", days, f"m{days}", ["o_orderpriority"])
    return d.select("o_orderpriority", "day", F.round("m90", 4).alias("v_90d"), F.round("m365", 4).alias("v_365d"))


@query("select full_date, strftime(full_date, '%Y-%m-%d') in ('2025-01-01', '2025-01-20', '2025-02-17', '2025-05-26', '2025-06-19') as is_us_bank_holiday from (select unnest(generate_series(date '2025-01-01', date '2025-12-31', interval 1 day))::date as full_date)")
def f8_bank_holidays(spark, sf_dir):
    return landing.calendar(spark, "2025-01-01", "2025-12-31").select("full_date", "is_us_bank_holiday")
