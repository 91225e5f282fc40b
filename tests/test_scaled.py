import bisect
import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import buckets, deltas, feed, identity, intervals, layout, merge, quantiles, similarity, sketches, temporal
from tarnlake.session import scratch_path
from tarnlake.sources import variant
from tarnlake.streaming import closing, promises
from tarnlake.streaming import events as streams

START = dt.datetime(2025, 1, 1)
at = lambda minutes: START + dt.timedelta(minutes=minutes)
plain = lambda df: sorted(str(tuple(r)) for r in df.collect())


def hot_key(n, seed):
    """(key, minute) of which one key has half."""
    r = random.Random(seed)
    return [("hot" if i % 2 else f"k{r.randrange(40)}", r.randrange(60 * 24 * 20)) for i in range(n)]


def test_asof_by_buckets_splits_a_hot_key(spark):
    left = [(k, at(m), i) for i, (k, m) in enumerate(hot_key(900, 1))] + [("hot", None, 900), ("none", at(5), 901), (None, at(5), 902)]
    right = [(k, at(m // 7 * 7), v) for v, (k, m) in enumerate(hot_key(700, 2))] + [("hot", None, 700), ("k1", at(60 * 24 * 19), 701)]
    lf, rt = spark.createDataFrame(left, "k string, ts timestamp_ntz, id int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v int")
    for seconds in (3600, 86_400, 86_400 * 365):
        got = {r.id: r.asof_v for r in intervals.asof_join_bucketed(lf, rt, ["k"], "ts", "ts", ["v"], seconds, ["v"]).collect()}
        by = {}
        for k, t, v in right:
            if t is not None:
                by.setdefault(k, []).append((t, v))
        want = {i: max([x for x in by.get(k, []) if t is not None and x[0] <= t], default=(None, None))[1] for k, t, i in left}
        assert got == want
    n = Counter(("hot", t.date()) for k, t, *_ in [*left, *right] if k == "hot" and t)
    assert max(n.values()) < 0.1 * sum(n.values())


def test_asof_by_buckets_carries_over_empty_ones(spark):
    lf = spark.createDataFrame([("a", at(60 * 24 * 300), 1), ("a", at(-5), 2)], "k string, ts timestamp_ntz, id int")
    rt = spark.createDataFrame([("a", at(0), 7)], "k string, ts timestamp_ntz, v int")
    assert {r.id: r.asof_v for r in intervals.asof_join_bucketed(lf, rt, ["k"], "ts", "ts", ["v"], 60).collect()} == {1: 7, 2: None}
    assert plain(intervals.asof_join_bucketed(lf, rt.limit(0), ["k"], "ts", "ts", ["v"], 60).select("id", "asof_v")) == ["(1, None)", "(2, None)"]
    assert intervals.asof_join_bucketed(lf.limit(0), rt, ["k"], "ts", "ts", ["v"], 60).collect() == []


def test_buckets_rise_with_local_times_in_any_zone(spark):
    """In a zone that skips an hour, times without a zone stay in their own order; so do times with one."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2025, 3, 9, h, m) for h in range(5) for m in (0, 30)] + [dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(1850, 1, 1)]
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").withColumn("z", F.col("t").cast("timestamp"))
        for c, kind in (("t", "timestamp_ntz"), ("z", "timestamp")):
            rows = df.select(F.col(c).alias("c"), intervals.micros(F.col(c), kind).alias("x"), intervals.bucket_of(c, 600, kind).alias("b")).orderBy("c").collect()
            assert [r.x for r in rows] == sorted(r.x for r in rows) and [r.b for r in rows] == [r.x // 600_000_000 for r in rows]
        lf = df.select("t", F.lit(1).alias("k"))
        got = intervals.asof_join_bucketed(lf, lf.withColumn("v", F.col("t")), ["k"], "t", "t", ["v"], 600).where("asof_v is null or asof_v <> t")
        assert got.count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_point_in_time_by_buckets_matches_the_interval_join(spark, how):
    log = spark.createDataFrame([(k, at(m), str(m % 5), i) for i, (k, m) in enumerate(hot_key(600, 3))], "k string, ts timestamp_ntz, a string, i int")
    v = merge.scd2_history(log, ["k"], "ts", ["a"], ["i"]).where("i % 7 <> 0").select("k", "a", "effective_start", "effective_end")
    f = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(hot_key(800, 4))] + [(900, "hot", None), (901, None, at(3))], "id int, fk string, t timestamp_ntz")
    want = temporal.pit_join(f, v, "fk", "k", "t", how=how).select("id", "fk", "t", "k", "a", "effective_start", "effective_end")
    got = intervals.pit_join_bucketed(f, v, "fk", "k", "t", 86_400, how=how).select("id", "fk", "t", "k", "a", "effective_start", "effective_end")
    assert plain(got) == plain(want) and want.count() > 500


def test_a_key_with_many_versions_costs_the_sum(spark):
    """One key, 20,000 versions and 50,000 facts: an all-pairs comparison would be 10^9."""
    v = spark.range(20_000).select(F.lit("x").alias("k"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 60).alias("effective_start"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("effective_end"))
    f = spark.range(50_000).select(F.col("id").alias("f"), F.lit("x").alias("fk"), F.timestamp_seconds(F.col("id") * 17).alias("t"))
    got = intervals.pit_join_bucketed(f, v, "fk", "k", "t", 3600).where("n <> floor(f * 17 / 60)")
    assert got.count() == 0 and intervals.pit_join_bucketed(f, v, "fk", "k", "t", 3600).count() == 50_000


def test_overlapping_spans_match_all_pairs(spark):
    r = random.Random(6)
    points = [(i, k, at(m)) for i, (k, m) in enumerate(hot_key(300, 7))] + [(300, None, at(1)), (301, "hot", None)]
    spans = [(i, k, at(m), at(m + r.choice([0, -4, 1, 30, 600, 60 * 24 * 40]))) for i, (k, m) in enumerate(hot_key(200, 8))] + [(200, "hot", at(0), None), (201, None, at(0), at(9)), (202, "hot", at(-60 * 24 * 400), at(60 * 24 * 4000))]
    p, s = spark.createDataFrame(points, "i int, k string, t timestamp_ntz"), spark.createDataFrame(spans, "j int, k string, a timestamp_ntz, b timestamp_ntz")
    want = Counter((i, j) for i, k, t in points for j, k2, a, b in spans if None not in (k, t, b) and k == k2 and a <= t < b)
    for seconds in (60, 3600, 86_400 * 100):
        assert Counter((x.i, x.j) for x in intervals.range_join(p, s, ["k"], "t", "a", "b", seconds).collect()) == want
    assert intervals.range_join(p, s.limit(0), ["k"], "t", "a", "b", 60).collect() == []


STATE = "k int, v string, n int"


def stored(spark, rows, **how):
    t = buckets.Bucketed(spark, scratch_path(spark, "buckets"), ["k"], **({"buckets": 16, "bucket": F.col("k")} | how))
    t.create(spark.createDataFrame(rows, STATE))
    return t


def up(held, batch):
    return merge.upsert(held, batch, ["k"])


def files(t):
    found, folders = set(), [t.path]
    while folders:
        for s in t._fs.listStatus(t._p(folders.pop())):
            name = s.getPath().toString()
            folders.append(name) if s.isDirectory() else found.add((name, s.getLen()))
    return {f for f in found if f[0].endswith(".parquet")}


def test_a_merge_writes_only_touched_buckets_and_a_replay_nothing(spark):
    t = stored(spark, [(i, f"v{i}", i) for i in range(3200)])
    before = files(t)
    batch = spark.createDataFrame([(5, "new", 1), (21, "new", 2), (3205, "came", 3)], STATE)
    assert t.merge(batch, up) == [5]
    size = sum(n for _, n in files(t) - before)
    assert before < files(t) and size < 0.2 * sum(n for _, n in before)
    assert t.merge(batch, up) == [] and t.versions() == [0, 1]
    want = {i: f"v{i}" for i in range(3200)} | {5: "new", 21: "new", 3205: "came"}
    assert {r.k: r.v for r in t.read().collect()} == want
    assert {r.k: r.v for r in t.read(0).collect()} == {i: f"v{i}" for i in range(3200)}


def test_a_merge_that_crashes_leaves_the_old_table(spark, monkeypatch):
    t = stored(spark, [(i, "a", i) for i in range(100)])
    batch = spark.createDataFrame([(1, "b", 1), (200, "c", 2)], STATE)
    before = plain(t.read())

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(t, "_commit", crash)
    with pytest.raises(OSError):
        t.merge(batch, up)
    assert t.versions() == [0] and plain(t.read()) == before
    monkeypatch.undo()
    assert t.merge(batch, up) == [1, 8] and t.read().count() == 101
    gone = t.vacuum(1)
    assert len(gone) == 4 and t.versions() == [1] and t.read().count() == 101 and t.vacuum(1) == []


def test_two_writers_of_one_version(spark):
    t = stored(spark, [(1, "a", 1)])
    other = buckets.Bucketed(spark, t.path, ["k"], 16, F.col("k"))
    m = t.manifest()
    other.merge(spark.createDataFrame([(1, "b", 1)], STATE), up)
    with pytest.raises(RuntimeError):
        t._write(t.read(0), m["parts"], [1], 1, m["schema"])
    assert [r.v for r in t.read().collect()] == ["b"]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_merges_by_hash_with_null_keys_and_deletes(spark, monkeypatch, limit):
    monkeypatch.setattr(buckets, "BROADCAST_KEYS", limit)
    rows = [(i, "a", 1) for i in range(50)] + [(None, "none", 0)]
    t = stored(spark, rows, bucket=None)
    t.merge(spark.createDataFrame([(None, "seen", 1), (7, None, 1), (60, "x", 1)], STATE), lambda held, b: merge.upsert(held, b, ["k"]).where("v is not null"))
    want = {i: "a" for i in range(50) if i != 7} | {None: "seen", 60: "x"}
    assert {r.k: r.v for r in t.read().collect()} == want
    assert t.merge(spark.createDataFrame([], STATE), up) == []
    t.merge(t.read().withColumn("v", F.lit(None).cast("string")), lambda held, b: merge.upsert(held, b, ["k"]).where("v is not null"))
    assert t.read().collect() == []


def test_a_merge_keeps_the_types_of_the_table(spark):
    t = buckets.Bucketed(spark, scratch_path(spark, "types"), ["k"], 4)
    t.create(spark.sql("select 1 as k, cast(1.5 as decimal(10,2)) as x union all select 2, cast(2 as decimal(10,2))"))
    t.merge(t.read().where("k = 1").withColumn("x", F.col("x") + 1), lambda held, b: merge.upsert(held, b, ["k"]))
    assert {r.k: float(r.x) for r in t.read().collect()} == {1: 2.5, 2: 2.0} and dict(t.read().dtypes)["x"] == "decimal(10,2)"


def test_scd2_in_buckets_is_the_history_of_the_log(spark):
    rows = [(k, at(m), str(m % 3), i) for i, (k, m) in enumerate(hot_key(400, 9))]
    log = spark.createDataFrame(rows, "k string, ts timestamp_ntz, a string, i int")
    how = (["k"], "ts", ["a"], ["i"])
    cut = at(60 * 24 * 10)
    t = buckets.Bucketed(spark, scratch_path(spark, "scd2"), ["k"], 8)
    t.create(merge.scd2_history(log.where(F.col("ts") < F.lit(cut)), *how))
    for part in (log.where((F.col("ts") >= F.lit(cut)) & (F.col("k") == "hot")), log.where((F.col("ts") >= F.lit(cut)) & (F.col("k") != "hot"))):
        t.merge(part, lambda held, batch: merge.scd2_apply(held, batch, *how))
    want = merge.scd2_history(log, *how)
    columns = ["k", "a", "effective_start", "effective_end", "is_current"]
    assert plain(t.read().select(columns)) == plain(want.select(columns))


def test_consumers_have_marks_of_their_own(spark):
    t = stored(spark, [(i, "a", i) for i in range(40)])
    one, two = feed.Consumer(t, "one"), feed.Consumer(t, "two")
    assert one.has_data() and one.mark() is None
    rows, v = one.pending()
    assert rows.count() == 40 and {r._change for r in rows.collect()} == {"insert"}
    one.commit(v)
    assert not one.has_data() and two.has_data()
    t.merge(spark.createDataFrame([(1, "b", 1), (2, "a", 2), (99, None, 0)], STATE), up)
    t.merge(spark.createDataFrame([(3, None, -1)], STATE), lambda held, b: held.limit(0))
    want = [("delete", 3, "a", 3), ("insert", 99, None, 0), ("update_after", 1, "b", 1), ("update_before", 1, "a", 1)]
    for _ in range(2):  # a look that is not committed
        assert one.has_data() and sorted(map(tuple, one.pending()[0].collect())) == want
    one.commit(one.pending()[1])
    assert not one.has_data() and one.pending()[0].collect() == [] and two.pending()[0].count() == 40
    with pytest.raises(ValueError):
        one.commit(0)


def test_vacuum_leaves_what_a_consumer_has_yet_to_read(spark):
    t = stored(spark, [(i, "a", i) for i in range(20)])
    slow = feed.Consumer(t, "slow")
    slow.commit(slow.pending()[1])
    for k in range(4):
        t.merge(spark.createDataFrame([(k, "b", 1)], STATE), up)
    t.vacuum(1)
    assert t.versions() == [0, 4] and t.marks() == {"slow": 0}
    assert sorted(r.k for r in slow.pending()[0].where("_change = 'update_after'").collect()) == [0, 1, 2, 3]
    slow.commit(slow.pending()[1])
    t.vacuum(1)
    assert t.versions() == [4] and t.read().count() == 20


def test_changes_see_nulls_and_null_keys(spark):
    a = spark.createDataFrame([(None, "x", 1), (1, None, 1), (2, "y", None)], STATE)
    b = spark.createDataFrame([(None, "x", 2), (1, None, 1), (2, None, None)], STATE)
    got = sorted(map(str, map(tuple, feed.changes_between(a, b, ["k"]).collect())))
    assert got == sorted(map(str, [("update_before", None, "x", 1), ("update_after", None, "x", 2), ("update_before", 2, "y", None), ("update_after", 2, None, None)]))
    assert plain(feed.replay(a, feed.changes_between(a, b, ["k"]), ["k"])) == plain(b)


def test_a_view_kept_by_changes_is_the_whole_build(spark):
    """Inserts, updates, deletes, moves between groups, a hot group with half of all rows, null groups and values, emptied groups."""
    r = random.Random(12)
    shape = "id int, g string, x decimal(12,2), d string"
    make = lambda i: (i, "hot" if i % 2 else r.choice(["a", "b", "c", None]), r.choice([None, *range(50)]), r.choice([None, *"uvwxyz"]))
    rows = {i: make(i) for i in range(300)} | {300: (300, "alone", 5, "q")}
    view = deltas.View(["g"], ["x"], ["x"], ["d"])
    df = lambda d: spark.createDataFrame([(i, g, None if x is None else __import__("decimal").Decimal(x), s) for i, g, x, s in d.values()], shape)
    state = buckets.Bucketed(spark, scratch_path(spark, "view"), ["g"], 8)
    state.create(view.build(df(rows)))
    for step in range(4):
        new = dict(rows)
        for i in r.sample(sorted(new), 40):
            new[i] = make(i) if r.random() < 0.6 else None
        new = {i: v for i, v in new.items() if v} | {1000 + step * 10 + k: make(1000 + step * 10 + k) for k in range(step * 3)}
        if step == 2:
            new = {i: v for i, v in new.items() if v[1] not in ("alone", "b")} | {2000: (2000, "born", 7, None)}
        if step == 3:
            new = {i: v for i, v in rows.items() if v[1] != "hot"}
        base = df(new)
        view.refresh(state, feed.changes_between(df(rows), base, ["id"]), base)
        rows = new
        assert plain(view.read(state.read())) == plain(view.read(view.build(base)))
    assert {x.g for x in state.read().select("g").collect()} >= {"a", None} and "alone" not in {x.g for x in state.read().select("g").collect()}


def test_only_marked_groups_are_read_again(spark, monkeypatch):
    view, built = deltas.View(["g"], ["x"], ["x"]), []
    base = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 2), (4, "b", 9)], "id int, g string, x int")
    new = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (5, "a", 3), (3, "b", 2)], "id int, g string, x int")
    real = deltas.View.build
    monkeypatch.setattr(deltas.View, "build", lambda self, df: built.append(df) or real(self, df))
    out = view.apply(real(view, base), feed.changes_between(base, new, ["id"]), new)
    assert plain(out.select("g", "n", "sum_x", "min_x", "max_x")) == ["('a', 3, 9, 1, 5)", "('b', 1, 2, 2, 2)"]
    assert {r.g for r in built[0].collect()} == {"b"}


def quantile(values, p):
    v, x = sorted(values), p * (len(values) - 1)
    lo = int(x)
    return v[lo] if lo == x else v[lo] + (v[lo + 1] - v[lo]) * (x - lo)


@pytest.mark.parametrize(("leaf", "bins", "broadcast"), [(4096, 4096, 50_000), (3, 4, 50_000), (3, 16, 0)])
def test_quantiles_match_sorted_values(spark, monkeypatch, leaf, bins, broadcast):
    """Ties, one value, two values, heavy tails, a hot group with half of all rows, null groups; nulls, NaN and infinities are left out."""
    for name, value in (("LEAF", leaf), ("BINS", bins), ("BROADCAST_INTERVALS", broadcast)):
        monkeypatch.setattr(quantiles, name, value)
    r = np.random.default_rng(3)
    groups = {"hot": r.normal(0, 1, 300).tolist(), "ties": [1.0] * 50 + [2.0] * 49, "one": [7.5], "two": [1.0, -1.0], "tail": np.exp(r.normal(0, 9, 90)).tolist(), None: [float(x) for x in range(60)], "wide": [-1.7e308, 1.7e308, 0.0], "empty": []}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("empty", None), ("empty", float("nan")), ("hot", float("inf")), ("hot", None), ("hot", float("-inf"))]
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(x.g, x.p): x.value for x in quantiles.exact_quantiles(df, ["g"], "v", ps).collect()}
    want = {(g, p): quantile(vs, p) for g, vs in groups.items() if vs for p in ps}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    if leaf == 3:
        every = [v for vs in groups.values() for v in vs]
        assert {x.p: x.value for x in quantiles.exact_quantiles(df, [], "v", [0.3, 0.5]).collect()} == pytest.approx({p: quantile(every, p) for p in (0.3, 0.5)}, rel=1e-12)
        assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", ps).collect() == []


def test_outliers_lie_beyond_the_widened_quartiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [*range(20), 900, -900]] + [(None, 1.0), (None, None)], "g string, v double")
    assert sorted(r.v for r in quantiles.outliers(df, ["g"], "v").collect()) == [-900, 900]


def test_sketches_roll_up_within_their_error(spark):
    r = random.Random(4)
    rows = [(at(r.randrange(60 * 24 * 90)), r.choice("ab"), r.randrange(9000), r.gauss(0, 1)) for _ in range(30_000)] + [(at(0), "a", None, None), (at(60 * 24 * 200), "c", None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, u int, v double")
    day = sketches.daily(df, "ts", ["k"], ["u"], ["v"])
    for states, name in ((sketches.roll_up(sketches.roll_up(day, "week", ["k"]), None, []), lambda d, k: 0), (sketches.roll_up(day, "month", ["k"]), lambda d, k: (d.replace(day=1).date(), k))):
        for row in sketches.read(states, [0.25, 0.5]).collect():
            label = 0 if "day" not in states.columns else (row.day, row.k)
            own = [x for x in rows if name(x[0], x[1]) == label]
            users, values = {x[2] for x in own} - {None}, sorted(x[3] for x in own if x[3] is not None)
            assert row.n == len(own) and abs(row.distinct_u - len(users)) <= max(1, 2 * sketches.DISTINCT_ERROR * len(users))
            for q, v in ((0.25, row.v_q25), (0.5, row.v_q50)):
                assert v is None and not values or abs(bisect.bisect_left(values, v) / len(values) - q) <= 2 * sketches.RANK_ERROR


def names(n, seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randrange(2, 4))) for _ in range(120)]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(2, 5))) for _ in range(n // 2)]
    while len(out) < n:
        w = list(r.choice(out))
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = r.choice("abcxyz")
        out.append("".join(w))
    return out


def gram_set(name):
    p = f"  {name.strip().lower()}  "
    return {p[i : i + 3] for i in range(len(p) - 2)} if name.strip() else set()


def test_ten_thousand_names_of_one_block_cost_their_near_pairs(spark):
    own = names(10_000, 5)
    sets = [gram_set(n) for n in own]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(own), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[g] for g in s]] = 1
    size, links = m.sum(1), set()
    for lo in range(0, len(own), 1000):
        shared = m[lo : lo + 1000] @ m.T
        a, b = np.nonzero(shared * 100 >= (size[lo : lo + 1000, None] + size - shared) * 40)
        links |= {(int(x) + lo, int(y)) for x, y in zip(a, b) if x + lo < y}
    df = spark.createDataFrame(list(enumerate(own)), "id int, name string")
    pairs, members = similarity.similar_pairs(df, "id", similarity.grams(similarity.clean("name")), 40)
    of = {r.id: r["class"] for r in members.collect()}
    near = {(r.a, r.b) for r in pairs.collect()}
    assert near == {tuple(sorted((of[a], of[b]))) for a, b in links if of[a] != of[b]} and len(near) > 1000
    assert all(of[a] == of[b] for a, b in links if sets[a] == sets[b])
    tokens, _ = similarity.prepared(df, "id", [], similarity.grams(similarity.clean("name")), 40, "jaccard")
    one = tokens.withColumn("_all", F.lit(0))
    tried = similarity.candidates(one, one, ["_all"], 40, same=True).count()
    assert len(links) <= tried < 0.02 * 10_000**2 / 2


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_similar_sets_match_all_pairs(spark, percent):
    own = [*names(120, 6), "", "  ", None, "aaaa", "aaaaaa", "AAAA "]
    rows = [(i, n, i % 2 if i % 11 else None) for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "id int, name string, block int")
    bag = lambda n: Counter((n or "").strip().lower())
    for measure, tokens, cut, fits in (
        ("jaccard", similarity.grams(similarity.clean("name")), lambda n: Counter(gram_set(n or "")), lambda s, x, y: 100 * s >= percent * (x + y - s)),
        ("dice", similarity.letters(similarity.clean("name")), bag, lambda s, x, y: 200 * s >= percent * (x + y)),
    ):
        pairs, members = similarity.similar_pairs(df, "id", tokens, percent, ["block"], measure)
        of = {r.id: r["class"] for r in members.collect()}
        want = set()
        for i, a, x in rows:
            for j, b, y in rows:
                s, p, q = sum((cut(a) & cut(b)).values()), sum(cut(a).values()), sum(cut(b).values())
                if i < j and x is not None and x == y and p and q and fits(s, p, q) and of[i] != of[j]:
                    want.add(tuple(sorted((of[i], of[j]))))
        assert {(r.a, r.b) for r in pairs.collect()} == want


def test_links_of_people_are_those_of_all_pairs_of_a_block(spark):
    import difflib

    r = random.Random(8)
    last, first = names(60, 9), names(60, 10)
    people = [(i, r.choice(first), r.choice([*last, "", None]), r.choice(["d1", "d2"]), r.choice(["1", "2", None, None])) for i in range(160)]
    df = spark.createDataFrame(people, "id long, first_name string, last_name string, dob string, ssn_last4 string")
    like = lambda a, b: difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() >= 0.75
    got = identity.resolve(df)
    root = {p[0]: p[0] for p in people}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in people:
        for b in people:
            if a[0] >= b[0] or a[3] is None or a[3] != b[3] or a[2] is None or b[2] is None:
                continue
            same_ssn = a[4] is not None and a[4] == b[4] and (like(a[2], b[2]) or like(b[2], a[2]))
            bare = None in (a[4], b[4]) and a[2] == b[2] and (like(a[1], b[1]) or like(b[1], a[1]))
            if same_ssn or bare:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    assert {r.id: r.golden_id for r in got.collect()} == {i: find(i) for i in root}


def test_a_box_query_reads_few_rows_of_a_table_along_its_curve(spark):
    """Outliers, which would spoil even steps, and unlike types; the same box on the table as it came reads all of it."""
    df = spark.range(40_000).select(F.col("id"), (F.hash("id") % 1000).alias("a"), F.when(F.col("id") == 5, 1e12).otherwise(F.rand(1)).alias("b"), F.date_add(F.lit("2020-01-01"), F.abs(F.hash(F.col("id") + 7)).cast("int") % 365).alias("c"))
    path, plain_path = scratch_path(spark, "curve"), scratch_path(spark, "as-it-came")
    layout.write(df, path, ["a", "b", "c"], 64)
    df.repartition(64).write.parquet(plain_path)
    box = (F.col("a") > 700) & (F.col("b") < 0.1) & (F.col("c") < F.lit("2020-03-01"))
    want = df.where(box).agg(F.sum("id")).first()[0]
    for p, most, least in ((path, 0.15, 0), (plain_path, 1, 0.9)):
        rows, read = layout.rows_read(spark.read.parquet(p).where(box).agg(F.sum("id")))
        assert rows[0][0] == want and least * 40_000 <= read <= most * 40_000


def test_ranks_and_curve_match_plain_code(spark):
    values = [None, "b", "a", "zz", "m", "b", ""]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    cuts = layout.cut_points(df, ["v", "i"], 2)
    got = {r.i: (r.x, r.y, r.z) for r in df.select("i", layout.rank("v", cuts["v"]).alias("x"), layout.rank("i", cuts["i"]).alias("y")).withColumn("z", layout.z_order([F.col("x"), F.col("y")], 2)).collect()}
    for i, v in enumerate(values):
        x, y = layout.place(cuts["v"], v), layout.place(cuts["i"], i)
        z = sum((x >> b & 1) << (2 * b + 1) | (y >> b & 1) << (2 * b) for b in range(2))
        assert got[i] == (x, y, z)
    assert layout.clustered(df.limit(0), ["v", "i"], 4).count() == 0 and layout.clustered(df, ["v"], 2).count() == len(values)


def test_variant_keeps_what_does_not_convert(spark):
    texts = ['{"k": 5, "s": "a", "n": {"x": [1, 2]}}', '{"k": "text", "z": null}', None, "not json", "[1,2]", "7", '{"k": "12"}', "{}", '{"k": null}', "null", '{"k": 1e3}', ""]
    df = variant.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    got = {r.i: r for r in variant.typed(df, "v", {"k": ("$.k", "int"), "x": ("$.n.x[1]", "int")}).collect()}
    assert [got[i].k for i in range(12)] == [5, None, None, None, None, None, 12, None, None, None, 1000, None] and got[0].x == 2
    assert [i for i in got if got[i]._mistyped] == [1] and [i for i in got if got[i].v_bad] == [3, 11]
    path = scratch_path(spark, "shred")
    variant.shred(df.drop("t"), "v", {"k": "int", "s": "string"}).write.parquet(path)
    rest = {r.i: (r.k, r.s, r.rest) for r in spark.read.parquet(path).select("i", "k", "s", F.to_json("v_rest").alias("rest")).collect()}
    assert rest[0] == (5, "a", '{"n":{"x":[1,2]}}') and rest[1] == (None, None, '{"k":"text","z":null}') and rest[4] == (None, None, "[1,2]") and rest[6] == (12, None, "{}") and rest[2] == rest[3] == (None, None, None)


def replayed(rows, held):
    """Plain replay: {promise: (status, amount, paid)}. ``held``: [loan, id, amount, paid, due] of promises that were open before."""
    queue, out = {}, {}
    for loan, *item in held:
        queue.setdefault(loan, []).append(item)
    for loan, kind, pid, amount, t, due in sorted(rows, key=lambda r: (r[4], r[1] != "promise", r[2])):
        own = queue.setdefault(loan, [])
        for p in [p for p in own if p[3] < t or p[2] >= p[1]]:
            own.remove(p)
            out[p[0]] = p
        if kind == "promise":
            own.append([pid, amount, 0, due])
        else:
            for p in list(own):
                part = min(amount, p[1] - p[2])
                p[2] += part
                amount -= part
                if p[2] == p[1]:
                    own.remove(p)
                    out[p[0]] = p
    for own in queue.values():
        out |= {p[0]: p for p in own}
    return {i: ("Kept" if paid >= amount else "Partial" if paid else "Broken", amount, paid) for i, amount, paid, _ in out.values()}


def test_a_queue_of_promises_matches_a_plain_replay(spark):
    """Several open promises, payments that cover more than one, a start from a batch table, a restart, and dates that run backwards."""
    r = random.Random(11)
    rows, pid = [], 0
    for loan in range(12):
        for _ in range(40):
            pid += 1
            t = r.randrange(60 * 24 * 20)
            rows.append((loan, "promise", pid, r.choice([0, 500, 1000, 2500]), t, t + r.randrange(60 * 72)) if r.random() < 0.5 else (loan, "payment", pid, r.randrange(0, 4000), t, 0))
    held = [(loan, 10_000 + k, 3000, k * 500, 60 * (24 + 24 * k)) for loan in (0, 1) for k in (0, 1)]
    held = [(loan, i + loan * 10, a, p, due) for loan, i, a, p, due in held]
    shape = "loan_id long, kind string, promise_id long, amount long, event_time timestamp, due timestamp"
    make = lambda part: spark.createDataFrame([(a, k, i, x, at(t), at(d)) for a, k, i, x, t, d in part], shape)
    start = spark.createDataFrame([(a, i, x, p, at(d)) for a, i, x, p, d in held], "loan_id long, promise_id long, amount long, paid long, due timestamp")
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    before = promises.use_store(spark)
    try:
        cut = 60 * 24 * 9
        late = (0, "payment", 99_999, 77, cut + 60 * 24 * 11 + 5, 0)
        end = [(-1, "payment", 0, 0, 60 * 24 * 90, 0)]
        last = max(t for a, *_, t, _ in rows if a == 0)
        backwards = (0, "payment", 88_888, 55, last - 1, 0)
        for part in ([x for x in rows if x[4] < cut], [x for x in rows if x[4] >= cut], [backwards], end):
            make(part).coalesce(1).write.mode("append").parquet(src)
            df = promises.promise_queue(streams.file_source(spark, src, make([late]).schema, "parquet"), "10 days", start)
            q = streams.start(df, streams.append_sink(out), check)
            q.awaitTermination()
        assert closing.state_rows(q) <= 13 * 3
    finally:
        spark.conf.unset(promises.STORE[0]) if before is None else spark.conf.set(promises.STORE[0], before)
    got = {}
    for x in spark.read.parquet(out).collect():
        assert x.promise_id not in got
        got[x.promise_id] = (x.status, x.amount, x.paid)
    assert got.pop(88_888) == ("Refused", 55, 0)
    want = replayed(rows, [list(x) for x in held])
    assert got == want and {s for s, *_ in got.values()} == {"Kept", "Partial", "Broken"}


def test_state_of_closed_windows_ends_and_no_row_is_lost(spark):
    """Seven batches of a day each: state stays at the windows that are open, late rows are in the side output, each row is somewhere once."""
    r = random.Random(5)
    days = [[(k * 100 + i, "ab"[i % 2], at(60 * 24 * k + r.randrange(60 * 24))) for i in range(30)] + ([(k * 100 + 90, "a", at(60 * 24 * (k - 3)))] if k > 3 else []) for k in range(7)]
    src, held, late, marks, out, one, two = (scratch_path(spark, n) for n in ("s", "held", "late", "marks", "out", "one", "two"))
    shape, most = "id int, k string, event_time timestamp", 0
    for day in days:
        spark.createDataFrame(day, shape).coalesce(1).write.mode("append").parquet(src)
        parted = closing.part_late(held, late, marks, closing.last_end("event_time", "3 hours"))
        first = streams.start(streams.file_source(spark, src, spark.createDataFrame([], shape).schema, "parquet"), parted, one)
        first.awaitTermination()
        w = streams.windowed(closing.staged(spark, held, spark.createDataFrame([], shape).schema), ["k"], [F.count("*").alias("n"), F.collect_list("id").alias("ids")], size="3 hours")
        q = streams.start(w, streams.append_sink(out), two)
        q.awaitTermination()
        assert closing.dropped_rows(q) == 0
        most = max(most, closing.state_rows(q))
    # The windows of one day; without an end there would be some hundred rows.
    assert most <= 16
    rows = [x for day in days for x in day]
    top = max(t for *_, t in rows) - dt.timedelta(minutes=30)
    side = sorted(x.id for x in spark.read.parquet(late).collect())
    assert side == [k * 100 + 90 for k in range(4, 7)]
    got = [i for x in spark.read.parquet(out).collect() for i in x.ids]
    end = lambda t: START + ((t - START) // dt.timedelta(hours=3) + 1) * dt.timedelta(hours=3)
    assert sorted(got) == sorted(i for i, _, t in rows if i not in side and end(t) <= top)
    # A batch that is run again replaces what it wrote.
    batch = spark.createDataFrame(days[-1], shape)
    parted(batch, 6)
    assert sorted(x.id for x in spark.read.parquet(late).collect()) == side and spark.read.parquet(held).count() + len(side) == len(rows)
