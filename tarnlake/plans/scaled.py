"""Joins, merges, feeds and summaries that hold for hot keys and large states (J, DML, SNK, SRC, A, X), as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import buckets, deltas, feed, intervals, layout, merge, quantiles, similarity, sketches
from tarnlake.operators.tables import lookup_options
from tarnlake.plans.common import VERSIONS, priority_log, table
from tarnlake.plans.history import _versions
from tarnlake.session import scratch_path
from tarnlake.sources import variant
from tarnlake.streaming import closing, promises
from tarnlake.streaming import events as streams

QUERIES, ORACLE = {}, {}
DAY = 86_400
#: Keys that one file's Bloom filter is made for.
BLOOM_KEYS = 100_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("select p.event_id, p.user_id, c.event_id as asof_event_id, c.value as asof_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts")
def j5_asof_bucketed(spark, sf_dir):
    """The last click before each purchase, by buckets of a day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    p, c = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'")
    return intervals.asof_join_bucketed(p, c, ["user_id"], "ts", "ts", ["event_id", "value"], DAY, ["event_id"]).drop("ts")


@query("""with e as (select event_id, event_type, ts, user_id % 2 as half, user_id from events),
l as (select * from e where event_type = 'view'), r as (select * from e where event_type = 'error'),
m as (select l.event_id, l.half, r.event_id as hit, row_number() over (partition by l.event_id order by r.ts desc, r.event_id desc) as rn from l left join r on r.half = l.half and r.ts <= l.ts and r.ts > l.ts - interval 1 day)
select event_id, half, hit as asof_event_id from m where rn = 1""")
def w10_asof_two_keys(spark, sf_dir):
    """The last error of its half of all users within a day before each view: two keys hold all rows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("user_id") % 2).alias("half"))
    l_, r = e.where("event_type = 'view'").select("event_id", "half", "ts"), e.where("event_type = 'error'").select("event_id", "half", "ts")
    j = intervals.asof_join_bucketed(l_, r, ["half"], "ts", "ts", ["event_id", "ts"], 3600, ["event_id"])
    near = F.col("asof_ts") > F.col("ts") - F.expr("interval 1 day")
    return j.select("event_id", "half", F.when(near, F.col("asof_event_id")).alias("asof_event_id"))


@query(f"with {VERSIONS} select l_orderkey, l_linenumber, l_extendedprice, v.o_orderpriority, v.effective_start from lineitem join (select o_orderkey, o_custkey, o_orderdate from orders) o on o_orderkey = l_orderkey join versions v on v.o_custkey = o.o_custkey and o.o_orderdate >= v.effective_start and o.o_orderdate < v.effective_end")
def j3_point_in_time_bucketed(spark, sf_dir):
    """Lines with the customer version in force at their order's date, by one as-of join in buckets of a year."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderdate")
    j = intervals.pit_join_bucketed(li.join(o, li.l_orderkey == o.o_orderkey), _versions(spark, sf_dir), "cust", "o_custkey", "o_orderdate", 365 * DAY)
    return j.select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderpriority", "effective_start")


@query(f"with {VERSIONS} select e.event_id, e.user_id, v.o_orderpriority from events e left join versions v on v.o_custkey = e.user_id and e.ts - interval 26 years >= v.effective_start and e.ts - interval 26 years < v.effective_end")
def j4_point_in_time_left_bucketed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("ts - interval 26 years").alias("at"))
    return intervals.pit_join_bucketed(e, _versions(spark, sf_dir), "user_id", "o_custkey", "at", 365 * DAY, how="left").select("event_id", "user_id", "o_orderpriority")


@query("""with s as (select o_custkey % 5 as team, o_orderkey, o_orderdate as opened, o_orderdate + to_days((o_orderkey % 400)::int) as closed from orders where o_orderstatus <> 'P')
select p.o_orderkey, count(*) as open_orders, sum(s.o_orderkey)::bigint as keys from (select o_orderkey, o_custkey % 5 as team, o_orderdate from orders where o_orderstatus = 'P') p join s on s.team = p.team and p.o_orderdate >= s.opened and p.o_orderdate < s.closed group by 1""")
def j3_overlapping_spans(spark, sf_dir):
    """How many orders of its team are open when each pending order comes in: spans overlap, and five keys hold all rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("team"), "o_orderdate", "o_orderstatus")
    p = o.where("o_orderstatus = 'P'").select("o_orderkey", "team", "o_orderdate")
    days = F.make_dt_interval(days=(F.col("o_orderkey") % 400).cast("int"))
    s = o.where("o_orderstatus <> 'P'").select("team", F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("opened"), (F.col("o_orderdate") + days).alias("closed"))
    each = intervals.open_totals(p, s, ["team"], "o_orderdate", "opened", "closed", ["key"], 30 * DAY, "open_orders").where("open_orders > 0")
    return each.groupBy("o_orderkey").agg(F.sum("open_orders").alias("open_orders"), F.sum("key").alias("keys"))


@query(f"with {VERSIONS} select *, effective_end = timestamp '9999-12-31' as is_current from versions")
def dml3_scd2_buckets(spark, sf_dir):
    """A history in buckets; three batches, the last one twice, each rewriting the buckets of its own keys alone."""
    log = priority_log(spark, sf_dir)
    cut = lambda a, b: log.where((F.col("o_orderdate") >= F.lit(a).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(b).cast("timestamp_ntz")))
    how = (["o_custkey"], "o_orderdate", ["o_orderpriority"], ["o_orderkey"])
    t = buckets.Bucketed(spark, scratch_path(spark, "scd2"), ["o_custkey"], 16)
    t.create(merge.scd2_history(cut("1900-01-01", "1997-01-01"), *how))
    for a, b in (("1997-01-01", "1999-06-01"), ("1999-06-01", "2100-01-01"), ("1999-06-01", "2100-01-01")):
        t.merge(cut(a, b), lambda held, batch: merge.scd2_apply(held, batch, *how))
    return t.read().select("o_custkey", "o_orderpriority", "effective_start", "effective_end", "is_current")


@query("""with c as (select o_orderkey, o_orderkey % 64 as b from orders where o_orderkey % 64 in (3, 4, 5) and o_orderkey % 2 = 1)
select o_orderkey, case when o_orderkey in (select o_orderkey from c) then 'X' else o_orderstatus end as o_orderstatus, o_orderkey % 64 in (select b from c) as rewritten from orders
""")
def dml7_touched_buckets(spark, sf_dir):
    """A small batch and its replay: each row with whether its bucket was rewritten, read from the manifests."""
    t = buckets.Bucketed(spark, scratch_path(spark, "touched"), ["o_orderkey"], 64, F.col("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t.create(o)
    batch = o.where("o_orderkey % 64 in (3, 4, 5) and o_orderkey % 2 = 1").withColumn("o_orderstatus", F.lit("X"))
    for _ in range(2):
        t.merge(batch, lambda held, new: merge.upsert(held, new, ["o_orderkey"]))
    moved = t.changed_buckets(0, t.versions()[-1])
    return t.read().withColumn("rewritten", F.pmod("o_orderkey", F.lit(64)).isin(moved))


def _steps(spark, sf_dir: str) -> tuple[buckets.Bucketed, DataFrame]:
    """Orders of two statuses as a table by key."""
    t = buckets.Bucketed(spark, scratch_path(spark, "feed"), ["o_orderkey"], 32)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    t.create(o.where("o_orderkey % 5 <> 0"))
    return t, o


def _edits(o: DataFrame):
    """A merge that adds, changes and deletes: deleted keys come with a null status."""
    batch = o.where("o_orderkey % 5 = 0").unionByName(o.where("o_orderkey % 7 = 1 and o_orderkey % 5 <> 0").withColumn("price", F.col("price") + 1)).unionByName(o.where("o_orderkey % 11 = 2 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 1").withColumn("o_orderstatus", F.lit(None).cast("string")))
    return batch, lambda held, new: merge.upsert(held, new, ["o_orderkey"]).where("o_orderstatus is not null")


_FEED = """
d as (select o_orderkey as k, cast(o_totalprice as decimal(18,2)) as price from orders),
f as (select 'insert' as change, k, price from d where k % 5 = 0
    union all select 'update_before', k, price from d where k % 7 = 1 and k % 5 <> 0 union all select 'update_after', k, price + 1 from d where k % 7 = 1 and k % 5 <> 0
    union all select 'delete', k, price from d where k % 11 = 2 and k % 5 <> 0 and k % 7 <> 1)
"""


@query(f"""with {_FEED}, g as (select change, count(*) as n, sum(k)::bigint as keys, cast(sum(price) as double) as amount from f group by 1),
a as (select 'insert' as change, count(*) as n, sum(k)::bigint as keys, cast(sum(price) as double) as amount from d where k % 5 <> 0)
select 'first' as look, * from a union all select 'second', * from g union all select 'again', * from g""")
def src17_change_feed(spark, sf_dir):
    """What one consumer sees: all rows at first; then, after a batch, its inserts, updates and deletes, and these again because it failed
    before its commit. Another consumer has a mark of its own, and having no data is seen without reading."""
    t, o = _steps(spark, sf_dir)
    one, other = feed.Consumer(t, "one"), feed.Consumer(t, "other")
    seen = lambda look, rows: rows.groupBy(F.col("_change").alias("change")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("price").cast("double").alias("amount")).withColumn("look", F.lit(look))
    rows, version = one.pending()
    out = seen("first", rows)
    one.commit(version)
    if one.has_data() or not other.has_data():
        raise RuntimeError("a mark is wrong")
    t.merge(*_edits(o))
    out = out.unionByName(seen("second", one.pending()[0]))
    rows, version = one.pending()
    out = out.unionByName(seen("again", rows))
    one.commit(version)
    return out if not one.has_data() and other.mark() is None else out.limit(0)


@query("with o as (select o_orderkey, o_custkey, cast(o_totalprice as decimal(18,2)) as p from orders) select o_orderkey, o_custkey, cast(case when o_orderkey % 7 = 1 and o_orderkey % 5 <> 0 then p + 1 else p end as double) as price from o where o_orderkey % 5 = 0 or o_orderkey % 7 = 1 or o_orderkey % 11 <> 2")
def src17_replica(spark, sf_dir):
    """A copy kept up by the feed is the table."""
    t, o = _steps(spark, sf_dir)
    reader = feed.Consumer(t, "replica")
    rows, version = reader.pending()
    copy = rows.drop("_change")
    reader.commit(version)
    t.merge(*_edits(o))
    return feed.replay(copy, reader.pending()[0], ["o_orderkey"]).select("o_orderkey", "o_custkey", F.col("price").cast("double").alias("price"))


@query("""with o as (select o_orderkey as k, o_custkey as c, o_orderpriority as priority, cast(o_totalprice as decimal(18,2)) as p from orders),
n as (select k, c, case when k % 7 = 1 then '1-URGENT' else priority end as priority, case when k % 7 = 1 then p + 1 else p end as p from o where not (k % 11 = 2 and k % 7 <> 1))
select priority, count(*) as n, cast(sum(p) as double) as amount, round(cast(sum(p) as double) / count(*), 6) as mean, cast(min(p) as double) as least, cast(max(p) as double) as most from n group by 1""")
def snk8_view_by_deltas(spark, sf_dir):
    """Totals by priority kept up by a feed of inserts, updates that move rows to another group, and deletes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    t = buckets.Bucketed(spark, scratch_path(spark, "base"), ["o_orderkey"], 32)
    t.create(o.where("o_orderkey % 5 <> 0"))
    view, states = deltas.View(["priority"], ["p"], ["p"]), buckets.Bucketed(spark, scratch_path(spark, "view"), ["priority"], 8)
    reader = feed.Consumer(t, "view")
    states.create(view.build(t.read()))
    reader.commit(t.versions()[-1])
    urgent = o.where("o_orderkey % 7 = 1").withColumns({"priority": F.lit("1-URGENT"), "p": (F.col("p") + 1).cast("decimal(18,2)")})
    gone = o.where("o_orderkey % 11 = 2 and o_orderkey % 7 <> 1").withColumn("priority", F.lit(None).cast("string"))
    edit = lambda held, new: merge.upsert(held, new, ["o_orderkey"]).where("priority is not null")
    for batch in (o.where("o_orderkey % 5 = 0"), urgent.unionByName(gone)):
        t.merge(batch, edit)
        rows, version = reader.pending()
        view.refresh(states, rows, t.read(version))
        reader.commit(version)
    r = view.read(states.read())
    return r.select("priority", "n", F.col("sum_p").cast("double").alias("amount"), F.round("avg_p", 6).alias("mean"), F.col("min_p").cast("double").alias("least"), F.col("max_p").cast("double").alias("most"))


@query("select l_returnflag, l_linestatus, unnest([0.05, 0.25, 0.5, 0.75, 0.99]) as p, round(unnest(quantile_cont(cast(l_extendedprice as double), [0.05, 0.25, 0.5, 0.75, 0.99])), 6) as price from lineitem group by 1, 2")
def a11_quantiles_by_digits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    q = quantiles.exact_quantiles(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.99])
    return q.select("l_returnflag", "l_linestatus", "p", F.round("value", 6).alias("price"))


@query("with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1) select event_id, event_type, value from events join q using (event_type) where value < q1 - 0.5 * (q3 - q1) or value > q3 + 0.5 * (q3 - q1)")
def dq8_outliers_by_group(spark, sf_dir):
    """Values beyond their type's quartiles widened by half of their distance."""
    return quantiles.outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", 0.5)


@query("""with e as (select event_type, ts::date as day, user_id, value from events),
s as (select 'month' as unit, date_trunc('month', day)::date as day, event_type, * exclude (event_type, day) from e union all select 'week', date_trunc('week', day)::date, event_type, * exclude (event_type, day) from e union all select 'all', null, null, * exclude (event_type, day) from e)
select unit, day, event_type, count(*) as n, count(distinct user_id) as users, quantile_cont(value, 0.5) is not null as has_median, true as users_close, true as median_close from s group by 1, 2, 3""")
def a4_a12_sketch_roll_ups(spark, sf_dir):
    """Distinct users and median values by week and month, and over all: merged from daily sketches, each beside the exact figure that
    it must be close to (twice the stated error)."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "user_id", "value")
    days = sketches.daily(e, "ts", ["event_type"], ["user_id"], ["value"])
    months, weeks = sketches.roll_up(days, "month", ["event_type"]), sketches.roll_up(days, "week", ["event_type"])
    out = None
    for unit, states, keys in (("month", months, ["event_type"]), ("week", weeks, ["event_type"]), ("all", sketches.roll_up(months, None, []), [])):
        by = e.withColumn("day", F.to_date(F.date_trunc(unit, "ts"))) if keys else e
        on = ["day", *keys] if keys else []
        got = sketches.read(states, [0.5])
        exact = by.groupBy(*on).agg(F.count_distinct("user_id").alias("users"))
        j = got.join(exact, on) if on else got.crossJoin(F.broadcast(exact))
        # The rank of the median found: the share of values below it, and up to it.
        mid = F.col("value_q50")
        side = by.join(F.broadcast(got.select(*on, "value_q50")), on) if on else by.crossJoin(F.broadcast(got.select("value_q50")))
        rank = side.groupBy(*on).agg(F.avg((F.col("value") < mid).cast("double")).alias("below"), F.avg((F.col("value") <= mid).cast("double")).alias("upto"))
        j = j.join(rank, on) if on else j.crossJoin(F.broadcast(rank))
        slack = 2 * sketches.RANK_ERROR
        close = (F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)
        near = F.abs(F.col("distinct_user_id") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * (2 * sketches.DISTINCT_ERROR))
        none = lambda c: F.lit(None)
        row = j.select(F.lit(unit).alias("unit"), *[F.col(c) if c in on else none(c).cast("date" if c == "day" else "string").alias(c) for c in ("day", "event_type")], "n", "users", mid.isNotNull().alias("has_median"), near.alias("users_close"), close.alias("median_close"))
        out = row if out is None else out.unionByName(row)
    return out


_GRAMS = "list_distinct(list_transform(range(1, length(c_name) + 3), lambda i: substr('  ' || lower(trim(c_name)) || '  ', i, 3)))"


@query(f"""with c as (select c_custkey as id, c_mktsegment, {_GRAMS} as g from customer),
r as (select min(id) as id, c_mktsegment, list_sort(g) as g from c group by c_mktsegment, list_sort(g)),
p as (select a.id as a, b.id as b, a.c_mktsegment, len(list_intersect(a.g, b.g)) as shared, len(a.g) as size_a, len(b.g) as size_b from r a join r b on a.c_mktsegment = b.c_mktsegment and a.id < b.id)
select c_mktsegment, a, b, shared::int as shared, size_a::int as size_a, size_b::int as size_b from p where shared * 100 >= (size_a + size_b - shared) * 85""")
def er1_similar_names(spark, sf_dir):
    """Customers of one segment whose names share 85 percent of their three-letter stretches: five blocks hold all rows.
    Names with the same stretches are one class, named by its least customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return similarity.similar_pairs(c, "c_custkey", similarity.grams(similarity.clean("c_name")), 85, ["c_mktsegment"])[0]


_BOX = "l_shipdate >= timestamp '1999-01-01' and l_shipdate < timestamp '1999-04-01' and l_partkey < (select quantile_disc(l_partkey, 0.1) from lineitem) and l_extendedprice >= 20000"


@query(f"select count(*) as n, sum(l_orderkey)::bigint as orders, true as skipped from lineitem where {_BOX}")
def x1_x4_box(spark, sf_dir):
    """A box of three columns on a table along their Z-order: its rows, and whether the scan has read a fifth of the table at most."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_extendedprice")
    path = scratch_path(spark, "z-order")
    layout.write(li, path, ["l_shipdate", "l_partkey", "l_extendedprice"], 64)
    least = quantiles.exact_quantiles(li, [], "l_partkey", [0.1]).first().value
    t = spark.read.parquet(path)
    day = lambda d: F.lit(d).cast("date")
    box = t.where((F.col("l_shipdate") >= day("1999-01-01")) & (F.col("l_shipdate") < day("1999-04-01")) & (F.col("l_partkey") < int(least)) & (F.col("l_extendedprice") >= 20000.0))
    (row,), read = layout.rows_read(box.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders")))
    return spark.createDataFrame([(row.n, row.orders, read <= 0.2 * t.count())], "n long, orders long, skipped boolean")


#: Events as texts of several shapes: the published one, a text in place of the number, a nested object, a missing field, no JSON, a list.
_TEXT = "case event_id % 7 when 0 then props when 1 then '{\"k\": \"many\", \"user\": ' || user_id || '}' when 2 then '{\"k\": \"' || user_id || '\"}' when 3 then '{\"user\": ' || user_id || ', \"sub\": {\"type\": \"' || event_type || '\", \"ids\": [1, ' || event_id || ']}}' when 4 then '{' when 5 then null else '[' || event_id || ']' end"


@query("""with e as (select event_id, event_id % 7 as s, user_id, event_type, cast(props::json->>'$.k' as int) as k from events)
select event_id, case s when 0 then k when 2 then user_id end::int as k, case when s in (1, 3) then user_id end as user, case when s = 3 then event_type end as type, case when s = 3 then event_id when s = 6 then null end as second,
  case when s = 6 then event_id end as head, s = 1 as k_mistyped, s = 4 as bad,
  case s when 0 then 'BIGINT' when 1 then 'STRING' when 2 then 'STRING' end as kind from e""")
def src16_variant(spark, sf_dir):
    """Typed paths of a VARIANT: missing, of another type, nested and by index; what does not convert is named, what does not parse is marked."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_TEXT).alias("body"))
    path = scratch_path(spark, "variant")
    variant.parsed(e, "body", "v").select("event_id", "v", "v_bad").write.parquet(path)
    v = variant.typed(spark.read.parquet(path), "v", {"k": ("$.k", "int"), "user": ("$.user", "bigint"), "type": ("$.sub.type", "string"), "second": ("$.sub.ids[1]", "bigint"), "head": ("$[0]", "bigint")})
    return v.select("event_id", "k", "user", "type", "second", "head", F.array_contains("_mistyped", "k").alias("k_mistyped"), F.col("v_bad").alias("bad"), variant.kind_of("v", "$.k").alias("kind"))


@query("""with e as (select event_id, event_id % 7 as s, user_id, event_type, cast(props::json->>'$.k' as int) as k from events)
select event_id, case s when 0 then k when 2 then user_id end::int as k, case when s in (1, 3) then user_id end as user,
  case when s in (0, 2) then '{}' when s = 1 then '{"k":"many"}' when s = 3 then '{"sub":{"ids":[1,' || event_id || '],"type":"' || event_type || '"}}' when s = 6 then '[' || event_id || ']' end as rest from e""")
def f21_shredded(spark, sf_dir):
    """Hot fields as columns, the rest as VARIANT: a field that does not convert stays in the rest."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_TEXT).alias("body"))
    path = scratch_path(spark, "shredded")
    variant.shred(variant.parsed(e, "body", "v").select("event_id", "v"), "v", {"k": "int", "user": "bigint"}).write.parquet(path)
    return spark.read.parquet(path).select("event_id", "k", "user", F.to_json("v_rest").alias("rest"))


_TWO = "interval 36 hours"


@query(f"""with recursive ev as (select user_id, row_number() over (partition by user_id order by epoch_ms(ts), event_type = 'click', event_id) as i, event_id, event_type = 'purchase' as is_promise, cast(round(value * 100) as bigint) as amount, epoch_ms(ts) as t0 from events where event_type in ('purchase', 'click')),
steps as (
  select user_id, 0::bigint as i, []::struct(id bigint, amount bigint, paid bigint, due bigint)[] as queue, []::struct(id bigint, amount bigint, paid bigint, due bigint)[] as closed from (select distinct user_id from ev)
  union all
  select user_id, i, list_filter(paid, lambda x: x.paid < x.amount), list_concat(expired, list_filter(paid, lambda x: x.paid >= x.amount)) from (
    select *, case when is_promise then list_append(alive, {{'id': event_id, 'amount': amount, 'paid': 0::bigint, 'due': (t0 + 129600000)::bigint}})
      else list_transform(alive, lambda x, k: {{'id': x.id, 'amount': x.amount, 'paid': x.paid + greatest(0, least(x.amount - x.paid, amount - coalesce(list_sum(list_transform(alive[1:k - 1], lambda y: y.amount - y.paid)), 0)))::bigint, 'due': x.due}}) end as paid from (
      select s.user_id, ev.i, ev.event_id, ev.is_promise, ev.amount, ev.t0, list_filter(s.queue, lambda x: x.due >= ev.t0) as alive, list_filter(s.queue, lambda x: x.due < ev.t0) as expired from steps s join ev on ev.user_id = s.user_id and ev.i = s.i + 1))),
last as (select user_id, queue from steps qualify row_number() over (partition by user_id order by i desc) = 1),
done as (select user_id, unnest(closed) as x from steps union all select user_id, unnest(queue) from last)
select user_id as loan_id, x.id as promise_id, case when x.paid >= x.amount then 'Kept' when x.paid > 0 then 'Partial' else 'Broken' end as status, x.amount as amount, x.paid as paid from done""")
def st11_promise_queue(spark, sf_dir):
    """Purchases as promises due in 36 hours, clicks as payments to the oldest open ones: every promise as it closes, from a stream in two runs.
    Those that are open between the runs stay in state; a row in the far future ends all of them."""
    src, out, check = (scratch_path(spark, n) for n in ("promises", "closed", "checkpoint"))
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    kind = F.when(F.col("event_type") == "purchase", "promise").otherwise("payment")
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = e.select(F.col("user_id").alias("loan_id"), kind.alias("kind"), F.col("event_id").alias("promise_id"), cents.alias("amount"), F.col("ts").cast("timestamp").alias("event_time"), F.expr(f"cast(ts + {_TWO} as timestamp)").alias("due"))
    end = rows.agg(F.lit(-1).cast("bigint").alias("loan_id"), F.lit("payment").alias("kind"), F.lit(-1).cast("bigint").alias("promise_id"), F.lit(0).cast("bigint").alias("amount"), (F.max("due") + F.expr("interval 1 day")).alias("event_time"), F.max("due").alias("due"))
    half = F.col("event_time") < F.lit("2024-01-15").cast("timestamp")
    before = promises.use_store(spark)
    try:
        for part in (rows.where(half), rows.where(~half), end):
            part.write.mode("append").parquet(src)
            closed = promises.promise_queue(streams.file_source(spark, src, rows.schema, "parquet"))
            streams.start(closed, streams.append_sink(out), check).awaitTermination()
    finally:
        spark.conf.unset(promises.STORE[0]) if before is None else spark.conf.set(promises.STORE[0], before)
    return spark.read.parquet(out).select("loan_id", "promise_id", "status", "amount", "paid")


#: Three batches; the third brings the rows that the first two held back.
_BATCH = "case when event_id % 50 = 7 then 3 when ts < timestamp '2024-01-12' then 1 else 2 end"
_WINDOWS = f"""b as (select event_id, event_type, ts, {_BATCH} as batch from events),
m as (select batch, (select max(ts) from b p where p.batch < b.batch) - interval 30 minutes as mark from (select distinct batch from b) b),
r as (select b.*, time_bucket(interval 2 hours, ts, timestamp '2000-01-01') + interval 6 hours as last_end, mark from b join m using (batch))"""


@query(f"""with {_WINDOWS}, t as (select *, coalesce(last_end <= mark, false) as late from r),
w as (select unnest([time_bucket(interval 2 hours, ts, timestamp '2000-01-01') - to_hours(2 * k) for k in [0, 1, 2]]) as window_start, event_type, event_id, mark from t where not late),
g as (select window_start, event_type, count(*) as n, sum(event_id)::bigint as ids from w where coalesce(window_start + interval 6 hours > mark, true) group by 1, 2)
select 'window' as output, window_start, event_type, n, ids from g where window_start + interval 6 hours <= (select max(ts) from events) - interval 30 minutes
union all select 'late', null, event_type, count(*), sum(event_id)::bigint from t where late group by event_type""")
def st8_closing_windows(spark, sf_dir):
    """Windows of six hours every two, each once, when it has ended; rows whose windows have all ended go to a side output.
    A row of which some windows have ended counts in the others."""
    src, held, late, marks, out, one, two = (scratch_path(spark, n) for n in ("source", "staged", "late", "marks", "windows", "one", "two"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"), F.expr(_BATCH).alias("batch"))
    for k in (1, 2, 3):
        e.where(F.col("batch") == k).write.mode("append").parquet(src)
        parted = closing.part_late(held, late, marks, closing.last_end("event_time", "6 hours", "2 hours"))
        streams.start(streams.file_source(spark, src, e.schema, "parquet"), parted, one).awaitTermination()
        w = streams.windowed(closing.staged(spark, held, e.schema), ["event_type"], [F.count("*").alias("n"), F.sum("event_id").alias("ids")], size="6 hours", slide="2 hours")
        streams.start(w, streams.append_sink(out), two).awaitTermination()
    windows = spark.read.parquet(out).select(F.lit("window").alias("output"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "ids")
    side = spark.read.parquet(late).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return windows.unionByName(side.select(F.lit("late").alias("output"), F.lit(None).cast("timestamp_ntz").alias("window_start"), "event_type", "n", "ids"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, 1 as folders, true as by_priority from orders group by 1, 2")
def snk5_folders(spark, sf_dir):
    """A table in folders by two business columns: each row's folder says what the row says, and a group of both lies in one."""
    path = scratch_path(spark, "folders")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.regexp_replace("o_orderpriority", " ", "_").alias("priority"), "o_orderpriority")
    o.withColumn("status", F.col("o_orderstatus")).repartition("status", "priority").write.partitionBy("status", "priority").parquet(path)
    t = spark.read.parquet(path).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "(status=[^/]*/priority=[^/]*)/", 1))
    said = F.concat(F.lit("status="), "o_orderstatus", F.lit("/priority="), "priority")
    return t.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("folder").cast("int").alias("folders"), F.bool_and(F.col("folder") == said).alias("by_priority"))


@query("select k as o_custkey, count(o_orderkey) as n, case when k % 2 = 1 then 'none' else 'some' end as read from (select distinct 2 * o_custkey as k from orders where o_custkey < 12 union select 2 * o_custkey + 1 from orders where o_custkey < 12) w left join orders on 2 * o_custkey = k group by 1")
def x4_bloom_lookup(spark, sf_dir):
    """Lookups of keys that lie between the least and greatest of every row group: of absent ones the filter lets the scan read nothing."""
    path = scratch_path(spark, "bloom")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k"))
    # A file holds about half of the keys that its filter is made for, however many rows and keys the table has.
    files = max(4, -(-o.select("k").distinct().count() // (BLOOM_KEYS // 2)))
    options = {**lookup_options("k", BLOOM_KEYS, 1e-8), "parquet.enable.dictionary": "false"}
    o.repartition(files, "k").write.options(**options).parquet(path)
    t = spark.read.parquet(path)
    wanted = [r.k for r in o.where("k < 24").select("k").distinct().collect()]
    out = []
    for k in sorted(wanted):
        for key in (k, k + 1):
            (row,), read = layout.rows_read(t.where(F.col("k") == key).agg(F.count("*").alias("n")))
            out.append((key, row.n, "some" if read else "none"))
    return spark.createDataFrame(out, "o_custkey long, n long, read string")


@query("""with e as (select user_id, event_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 2 hours, true) as opens from events),
s as (select user_id, event_id, ts, sum(opens::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e),
g as (select user_id, min(ts) as session_start, max(ts) + interval 2 hours as session_end, count(*) as events from s group by user_id, k)
select * from g where epoch_ms(session_end) <= (select epoch_ms(max(ts)) from events) - 1800000""")
def st8_closing_sessions(spark, sf_dir):
    """Sessions of each user with gaps of two hours, from a stream in two runs: each comes out once, when the watermark has passed its end."""
    src, out, check = (scratch_path(spark, n) for n in ("source", "sessions", "checkpoint"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("event_time"))
    half = F.col("event_time") < F.lit("2024-01-15").cast("timestamp")
    for part in (e.where(half), e.where(~half)):
        part.write.mode("append").parquet(src)
        s = streams.sessions(streams.file_source(spark, src, e.schema, "parquet"), ["user_id"], gap="2 hours")
        streams.start(s, streams.append_sink(out), check).awaitTermination()
    held = spark.read.parquet(out)
    return held.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")
