import pytest
from pyspark.sql import functions as F

from tarnlake.operators import buckets, quality
from tarnlake.operators.measures import Model
from tarnlake.operators.tables import Versioned
from tarnlake.session import scratch_path
from tarnlake.sources import ingest
from tarnlake.sources.contracts import Contract
from tarnlake.streaming import events as streams


def landed(spark, rows, strategy="append_only"):
    """A contract whose files hold some (id, amount)."""
    path = scratch_path(spark, "landed")
    spark.createDataFrame(rows, "id int, amount double").write.option("header", True).csv(f"{path}/dt=2025-01-01" if strategy == "append_only" else path)
    return Contract("t", f"{path}/dt={{date}}" if strategy == "append_only" else path, {"id": "int", "amount": "double"}, ["id"], strategy=strategy), path


def test_a_replay_that_crashes_between_renames_loses_nothing(spark, monkeypatch):
    contract, path = landed(spark, [(1, 5.0), (2, -1.0), (3, 7.0)])
    bronze, side, log = (scratch_path(spark, n) for n in ("bronze", "side", "log"))
    go = lambda **k: ingest.ingest(spark, contract, "2025-01-01", bronze, side, log, **k)
    ids = lambda where: sorted(r.id for r in spark.read.parquet(f"{where}/t").collect())
    row = go(corrupt=F.col("amount") < 0)
    assert (row["row_count"], row["quarantined_count"]) == (2, 1) and ids(bronze) == [1, 3] and ids(side) == [2]
    real, calls = ingest._rename, []

    def second_fails(s, old, new):
        calls.append(old)
        if len(calls) == 2:
            raise OSError("lost")
        real(s, old, new)

    monkeypatch.setattr(ingest, "_rename", second_fails)
    with pytest.raises(OSError):
        go()
    monkeypatch.undo()
    own = f"{bronze}/t/_ingestion_date=2025-01-01"
    assert not ingest._exists(spark, own) and ingest.recover(spark, own) and ids(bronze) == [1, 3] and not ingest.recover(spark, own)
    # The same crash again; this time the replay itself ends it. Nothing is quarantined now, so the old side goes.
    calls.clear()
    monkeypatch.setattr(ingest, "_rename", second_fails)
    with pytest.raises(OSError):
        go()
    monkeypatch.undo()
    row = go()
    assert (row["row_count"], row["quarantined_count"]) == (3, 0) and ids(bronze) == [1, 2, 3] and not ingest._exists(spark, f"{side}/t/_ingestion_date=2025-01-01")


def test_a_whole_snapshot_takes_the_old_ones_place(spark, monkeypatch):
    contract, _ = landed(spark, [(1, 1.0), (2, 2.0)], "full_snapshot_overwrite")
    bronze, side, log = (scratch_path(spark, n) for n in ("bronze", "side", "log"))
    for _ in range(2):
        row = ingest.ingest(spark, contract, "2025-01-01", bronze, side, log)
        assert row["row_count"] == 2 and spark.read.parquet(f"{bronze}/t").count() == 2
    monkeypatch.setattr(ingest, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.ingest(spark, contract, "2025-01-01", bronze, side, log)
    assert spark.read.parquet(f"{bronze}/t").count() == 2


def test_a_day_goes_on_where_one_table_has_no_files(spark):
    contract, path = landed(spark, [(1, 1.0)])
    absent = Contract("a", f"{path}/nowhere/dt={{date}}", {"id": "int"}, ["id"])
    log = scratch_path(spark, "log")
    got = ingest.ingest_day(spark, {"t": contract, "a": absent}, "2025-01-01", scratch_path(spark, "b"), scratch_path(spark, "q"), log)
    assert [(r["table_name"], r["status"]) for r in got] == [("a", "NO_FILE_LANDED"), ("t", "SUCCESS")] and spark.read.parquet(log).count() == 2


def test_model_tests_from_yaml(spark):
    checks = quality.load_schema_tests("models: [{name: m, columns: [{name: k, tests: [not_null, unique, {relationships: {to: p, field: k}}]}, {name: s, tests: [{accepted_values: {values: [a], severity: warn}}]}]}]")
    t = {"m": spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (None, "a"), (9, "a")], "k int, s string"), "p": spark.createDataFrame([(1,)], "k int")}
    got = {r.check_name: (r.failed_count, r.status, r.severity) for r in quality.run_checks(t, checks, spark).collect()}
    assert got == {"not_null_k": (2, "FAILED", "FAIL"), "unique_k": (1, "FAILED", "FAIL"), "relationships_k": (1, "FAILED", "FAIL"), "accepted_values_s": (1, "FAILED", "WARN")}
    assert quality.load_schema_tests("") == []
    with pytest.raises(ValueError):
        quality.load_schema_tests("models: [{name: m, columns: [{name: k, tests: [odd]}]}]")


def test_achieved_rates_and_an_empty_table(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "x int")
    rates = {"even": (F.col("x") % 2 == 0, 0.5, 0.01), "large": (F.col("x") > 3, 0.5, 0.2)}
    assert {r.name: (r.achieved, r.ok) for r in quality.achieved_rates(df, rates).collect()} == {"even": (0.5, True), "large": (0.25, False)}
    assert {r.name: (r.achieved, r.ok) for r in quality.achieved_rates(df.limit(0), rates).collect()} == {"even": (None, False), "large": (None, False)}


def test_a_fact_reaches_what_its_links_reach(spark):
    of = lambda rows, shape: spark.createDataFrame(rows, shape)
    m = Model({"line": of([(1, 5), (1, 6), (2, 7), (9, 1)], "o int, q int"), "order": of([(1, 3), (2, 4)], "id int, c int"), "customer": of([(3, "x"), (4, "y")], "cid int, name string")}, {("line", "o"): ("order", "id"), ("order", "c"): ("customer", "cid")})
    m.measure("q", "line", lambda keep: F.sum(F.when(keep, F.col("q"))))
    m.measure("n", "order", lambda keep: F.count_if(keep))
    assert {r.name: (r.q, r.n) for r in m.evaluate(["q", "n"], ["name"]).collect()} == {"x": (11, 1), "y": (7, 1), None: (1, None)}


def test_checks_of_one_table_take_one_scan_beside_their_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "2025-01-01"), (1, None, -2.0, "2025-01-03"), (None, "a", 3.0, None), (None, "b", 4.0, None)], "k int, s string, x double, d string")
    q = quality.Check
    checks = [q("t", "key", "uniqueness", columns=["k"]), q("t", "both", "uniqueness", columns=["k", "s"]), q("t", "some", "uniqueness", columns=["k"], condition="k is not null"), q("t", "sum", "balance", column="x", control=6.0), q("t", "off", "balance", column="x", control=7.0, tolerance=0.1), q("t", "age", "freshness", column="d", as_of="2025-01-05", days=2), q("t", "n", "row_count", control=4), q("t", "more", "row_count", control=9, tolerance=0.1)]
    got = {k: v[:2] for k, v in quality.single_pass(df, checks).items()}
    assert got == {quality.ALL: (0, 4), "key": (2, 4), "both": (0, 4), "some": (1, 4), "sum": (0, 1), "off": (1, 1), "age": (0, 1), "n": (0, 4), "more": (5, 9)}
    empty = {k: v[0] for k, v in quality.single_pass(df.limit(0), checks).items()}
    assert empty["key"] == 0 and empty["age"] == 1 and empty["sum"] == 1 and empty["n"] == 4


def test_quartiles_of_a_large_table_come_from_all_tasks(spark, monkeypatch):
    df = spark.range(5000).select((F.hash("id") % 977).cast("double").alias("x"))
    one = quality.outlier_bounds(df, "x")
    monkeypatch.setattr(quality, "ONE_TASK", 0)
    assert quality.outlier_bounds(df, "x") == pytest.approx(one) and quality.outlier_bounds(df.limit(0), "x") == (float("-inf"), float("inf"))


def test_join_loss_by_a_column_is_one_join(spark):
    child = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (3, "b"), (3, "b")], "k int, g string")
    parent = spark.createDataFrame([(1,), (3,), (3,)], "p int")
    got = {r.g: (r.total, r.lost, r.passed) for r in quality.join_loss(child, "k", parent, "p", 0.4, by="g").collect()}
    assert got == {"a": (2, 1, False), "b": (3, 1, True), None: (5, 2, True)}


def test_whole_results_are_versions_and_a_reader_keeps_its_own(spark):
    path = scratch_path(spark, "whole")
    write = streams.complete_sink(path)
    write(spark.range(3), 0)
    held = Versioned(spark, path).read()
    write(spark.range(5), 1)
    assert held.count() == 3 and Versioned(spark, path).read().count() == 5
    write(spark.range(6), 1)
    write(spark.range(7), 2)
    assert Versioned(spark, path).read().count() == 7 and Versioned(spark, path).versions() == [1, 2]


def test_a_bucket_sink_reads_and_writes_its_own_buckets(spark, monkeypatch):
    table = buckets.Bucketed(spark, scratch_path(spark, "sink"), ["k"], 16, F.col("k"))
    write, read = streams.bucket_sink(table, ["t"]), []
    make = lambda rows: spark.createDataFrame(rows, "k int, t int, v string")
    write(make([]), 0)
    assert table.versions() == []
    write(make([(i, 1, "a") for i in range(64)] + [(0, 2, "b")]), 0)
    real = buckets.Bucketed.read
    monkeypatch.setattr(buckets.Bucketed, "read", lambda self, v=None, only=None: read.append(only) or real(self, v, only))
    for _ in range(2):  # a batch that is run again
        write(make([(3, 9, "late"), (99, 1, "x"), (99, 2, "y")]), 1)
    assert all(only == [3] for only in read) and table.versions() == [0, 1]
    got = {r.k: r.v for r in real(table).collect()}
    assert got == {i: "a" for i in range(1, 64)} | {0: "b", 99: "y"}
