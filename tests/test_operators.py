import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import columns
from tarnlake.operators import merge, quality, security, temporal
from tarnlake.operators.graph import connected_components
from tarnlake.operators.identity import resolve, survive
from tarnlake.operators.tables import Versioned, expire
from tarnlake.plans.orchestrate import Job, run
from tarnlake.sources import ingest, landing
from tarnlake.sources.contracts import Contract, classify, load_contracts
from tarnlake.sources import generate
from tarnlake.sources.generate import messy, portfolio

T = lambda d, h=0: dt.datetime(2025, 1, d, h)
LOG = "k string, ts timestamp_ntz, a string"


def test_unchanged_and_repeated_records_open_no_version(spark):
    log = spark.createDataFrame([("x", T(1), "p"), ("x", T(2), "p"), ("x", T(3), None), ("x", T(3), None), ("x", T(4), "q")], LOG)
    v = merge.scd2_history(log, ["k"], "ts", ["a"]).orderBy("ts").collect()
    assert [(r.a, r.is_current) for r in v] == [("p", False), (None, False), ("q", True)]
    assert all(x.effective_end == y.effective_start for x, y in zip(v, v[1:]))


def test_incremental_versions_match_history_and_replay(spark):
    rows = [(k, T(d), a) for k in "xyz" for d, a in ((1, "p"), (2, "q"), (5, "q"), (9, None), (12, "p"))]
    log = spark.createDataFrame(rows, LOG)
    state = merge.scd2_history(log.where("ts < timestamp_ntz'2025-01-03'"), ["k"], "ts", ["a"])
    for _ in range(2):
        state = merge.scd2_apply(state, log.where("ts >= timestamp_ntz'2025-01-03'"), ["k"], "ts", ["a"])
    assert sorted(map(str, state.collect())) == sorted(map(str, merge.scd2_history(log, ["k"], "ts", ["a"]).select(*state.columns).collect()))


def test_two_pass_form_duplicates_a_record_sent_again(spark):
    state = merge.scd2_history(spark.createDataFrame([("x", T(1), "p")], LOG), ["k"], "ts", ["a"])
    out = merge.scd2_two_pass(state, spark.createDataFrame([("x", T(2), "p")], LOG), ["k"], "ts", ["a"])
    assert out.where("is_current").count() == 2


def test_half_open_interval_never_doubles(spark):
    v = merge.scd2_history(spark.createDataFrame([("x", T(1), "p"), ("x", T(2), "q")], LOG), ["k"], "ts", ["a"])
    f = spark.createDataFrame([("x", T(2)), ("x", T(1, 5)), ("x", dt.datetime(2024, 1, 1))], "fk string, at timestamp_ntz")
    assert sorted(r.a for r in temporal.pit_join(f, v, "fk", "k", "at").collect()) == ["p", "q"]


def test_asof_takes_equal_times_and_breaks_ties(spark):
    left = spark.createDataFrame([(1, T(2)), (1, T(1)), (2, T(1))], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, T(2), 7), (1, T(2), 9), (1, T(1, 1), 5)], "k int, ts timestamp_ntz, v int")
    got = {(r.k, r.ts): r.asof_v for r in temporal.asof_join(left, right, ["k"], "ts", "ts", ["v"], ["v"]).collect()}
    assert got == {(1, T(2)): 9, (1, T(1)): None, (2, T(1)): None}


def test_upsert_is_idempotent_and_null_keys_match(spark):
    s = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    c = spark.createDataFrame([(None, 2), (3, 3)], "k int, v int")
    once = merge.upsert(s, c, ["k"])
    assert sorted(map(str, merge.upsert(once, c, ["k"]).collect())) == sorted(map(str, once.collect()))
    assert once.count() == 3


@pytest.mark.parametrize(
    "actual,kind", [(["a", "b"], "none"), (["a", "b", "x"], "additive"), (["a"], "breaking"), (["a", "old"], "none"), ([], "breaking")]
)
def test_drift_classes(actual, kind):
    assert classify(Contract("t", "p", {"a": "int", "b": "string"}, ["a"], renames={"old": "b"}), actual).kind == kind


def test_contracts_from_yaml_refuse_unknown_strategies():
    text = "tables:\n  t: {path: p, columns: {a: 'decimal(18,2)'}, natural_key: [a], strategy: %s}"
    assert load_contracts(text % "upsert")["t"].schema().fields[0].dataType.precision == 18
    with pytest.raises(ValueError):
        load_contracts(text % "other")


def test_ingest_quarantines_logs_and_replays(spark, tmp_path):
    d = tmp_path / "raw/dt=2025-01-01"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("id,old,amount\n1,x,1.50\n,y,2\n3,z,oops\n4,w,-1\n")
    c = Contract("t", f"{tmp_path}/raw/dt={{date}}", {"id": "int", "name": "string", "amount": "decimal(18,2)"}, ["id"], renames={"old": "name"})
    paths = [str(tmp_path / x) for x in ("bronze", "quarantine", "log")]
    for _ in range(2):
        row = ingest.ingest(spark, c, "2025-01-01", *paths, corrupt=F.col("amount") < 0)
        assert (row["status"], row["row_count"], row["quarantined_count"]) == ("SUCCESS", 1, 3)
    assert ingest.ingest(spark, c, "2025-01-02", *paths)["status"] == "NO_FILE_LANDED"
    assert spark.read.parquet(f"{paths[0]}/t").select("name").collect()[0][0] == "x"
    assert spark.read.parquet(paths[2]).count() == 3


def test_files_of_several_headers_join_by_name(spark, tmp_path):
    for i, text in enumerate(("a,b\n1,2\n", "b,a\n3,4\n", "a,c\n5,6\n")):
        p = tmp_path / f"dt=2025-01-0{i + 1}"
        p.mkdir()
        (p / "x.csv").write_text(text)
    df = landing.read_glob(spark, [str(p / "x.csv") for p in sorted(tmp_path.iterdir())], {"c": "b"})
    assert sorted((r.a, r.b, str(r.d)) for r in df.withColumn("d", landing.partition_date()).collect()) == [("1", "2", "2025-01-01"), ("4", "3", "2025-01-02"), ("5", "6", "2025-01-03")]


def test_versions_restore_vacuum_and_compact(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.write(spark.range(10).withColumn("b", F.col("id") % 3))
    t.write(t.read().where("id < 5"))
    t.restore(0)
    assert t.read().count() == 10 and t.read(1).count() == 5
    t.compact(["id", "b"], 2, zorder=True)
    assert t.vacuum(1) == [0, 1, 2] and t.read().count() == 10
    with pytest.raises(ValueError):
        t.read(0)
    assert expire(spark.sql("select date'2025-01-01' as d union all select date'2024-01-01'"), "d", 30, F.lit("2025-01-10").cast("date")).count() == 1


def test_checks_skip_fail_and_gate(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 2.0), (None, 3.0)], "k int, v double")
    C = quality.Check
    res = quality.run_checks({"t": df}, [C("t", "c", "completeness", column="k", tolerance=0.5), C("t", "u", "uniqueness", columns=["k"]), C("t", "n", "non_negative", column="v", severity="WARN"), C("t", "r", "rule"), C("t", "bad", "rule", condition="nope > 1"), C("gone", "g", "rule")], spark)
    got = {r.check_name: (r.status, r.failed_count) for r in res.collect()}
    assert got == {"c": ("PASSED", 1), "u": ("FAILED", 1), "n": ("FAILED", 1), "r": ("SKIPPED", 0), "bad": ("FAILED", -1), "g": ("SKIPPED", 0)}
    assert not quality.gate(res)
    assert "<table>" in quality.dashboard(res)
    assert quality.orphans(df, "k", spark.range(1), "id", True).count() == 3 and quality.orphans(df, "k", spark.range(1), "id").count() == 2


def test_masks_and_rows_fail_closed(spark):
    df = spark.createDataFrame([("555-123-4567", "a@b.c", 1)], "p string, e string, o int")
    users = spark.createDataFrame([("u", 1, "t")], "username string, collector_id int, team_name string")
    m = security.masked(df, {"p": "phone", "e": "email"}, "stranger").first()
    assert (m.p, m.e) == ("*******-4567", "***@b.c")
    assert security.row_filter(df, users, "u", "stranger", "o").count() == 0
    assert security.row_filter(df, users, "u", security.COLLECTOR, "o").count() == 1
    assert not security.allowed("stranger", "kpi") and security.allowed(security.EXECUTIVE, "kpi")


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_survivor_takes_the_best_source(spark):
    people = spark.createDataFrame([(1, "CRM", "A", "Xu", "d", "1", None), (2, "BUREAU", "A", "Xu", "d", "1", "m@x")], "id long, source string, first_name string, last_name string, dob string, ssn_last4 string, email string")
    out = survive(resolve(people), ["first_name", "email"], {"CRM": 0, "BUREAU": 1}).first()
    assert (out.golden_id, out.first_name, out.email, out.records) == (1, "A", "m@x", 2)


def test_domain_functions(spark):
    r = spark.range(1).select(columns.instalment(F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("i"), columns.ratio(F.lit(1), F.lit(0)).alias("z"), columns.parse_details(F.lit("a=1;b=2"))["b"].alias("b"), columns.rag(F.lit(0.1), 0.1, 0.07).alias("c")).first()
    assert (r.i, r.z, r.b, r.c) == (100.0, None, "2", "Red")


def test_jobs_run_in_order_retry_and_block():
    seen, fails = [], {"b": 1}

    def job(n):
        def f():
            seen.append(n)
            if fails.get(n, 0):
                fails[n] -= 1
                raise RuntimeError(n)

        return f

    done = run([Job("c", job("c"), ["b"]), Job("a", job("a")), Job("b", job("b"), ["a"], retries=1), Job("x", lambda: 1 / 0), Job("y", job("y"), ["x"]), Job("off", job("off"), active=False)])
    assert seen == ["a", "b", "b", "c"] and {k: v.status for k, v in done.items()} == {"a": "DONE", "b": "DONE", "c": "DONE", "x": "FAILED", "y": "BLOCKED", "off": "INACTIVE"}


def test_generated_portfolio_is_repeatable(spark):
    one = portfolio(spark, 40, "2025-01-01", 20).orderBy("loan_id", "snapshot_date").collect()
    two = portfolio(spark, 40, "2025-01-01", 20).repartition(3).orderBy("loan_id", "snapshot_date").collect()
    assert one == two and len(one) == 800
    pay = spark.range(20000).select(F.col("id").cast("string").alias("payment_id"), F.lit(10.0).alias("payment_amount"), F.lit("2025-01-01").cast("timestamp").alias("effective_date"))
    m = messy(pay)
    assert 150 < m.groupBy("payment_id").count().where("count > 1").count() < 260
    assert 300 < m.where("is_reversal_flag").count() < 500


def test_generated_loans_reach_every_state_and_contacts_follow_them(spark):
    days = portfolio(spark, 1500, "2025-01-01", 300)
    assert {r.bucket_index for r in days.select("bucket_index").distinct().collect()} == set(range(7)) and days.where("restructured").count() > 0
    c = generate.contacts(days)
    share = {r.channel_code: r.n for r in c.groupBy("channel_code").agg(F.count("*").alias("n")).collect()}
    assert abs(share["OUTBOUND_CALL"] / sum(share.values()) - 0.35) < 0.03
    status = {r.ptp_status: r.n for r in generate.promises_to_pay(c).groupBy("ptp_status").agg(F.count("*").alias("n")).collect()}
    assert abs(status["Kept"] / sum(status.values()) - 0.65) < 0.05 and min(status.values()) > 0


def test_bureau_scores_skip_the_outage_and_some_are_late(spark):
    b = generate.bureau(generate.loans(spark, 3000), "2025-01-01", "2025-04-30", ["2025-02-03"])
    assert {str(r.file_date) for r in b.select("file_date").distinct().collect()} == {"2025-01-03", "2025-03-03", "2025-04-03"}
    late = b.agg(F.avg(F.col("is_late_arrival").cast("int"))).first()[0]
    assert 0.03 < late < 0.07
    assert not b.groupBy("customer_id", "file_date").count().where("count > 1").count()


def test_a_replay_that_empties_one_side_leaves_no_stale_rows(spark, tmp_path):
    d = tmp_path / "raw/dt=2025-01-01"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("id,amount\n1,5\n2,6\n")
    c = Contract("t", f"{tmp_path}/raw/dt={{date}}", {"id": "int", "amount": "int"}, ["id"])
    paths = [str(tmp_path / x) for x in ("bronze", "quarantine", "log")]
    assert ingest.ingest(spark, c, "2025-01-01", *paths)["row_count"] == 2
    row = ingest.ingest(spark, c, "2025-01-01", *paths, corrupt=F.col("amount") > 0)
    assert (row["row_count"], row["quarantined_count"]) == (0, 2)
    assert spark.read.schema("id int").parquet(f"{paths[0]}/t").count() == 0


def test_short_phones_are_masked(spark):
    df = spark.createDataFrame([("12345",), ("1234567",), ("555-010-1234",), (None,)], "phone string")
    got = [r[0] for r in df.select(security.mask("phone", F.col("phone"), security.ANALYST)).collect()]
    assert got == ["*******", "*******", "*******-1234", None]


def test_absent_dependencies_and_timeouts_fail():
    import time

    with pytest.raises(ValueError):
        run([Job("a", lambda: None, after=["nobody"])])
    out = run([Job("slow", lambda: time.sleep(2), timeout=0.1, retries=3), Job("next", lambda: None, after=["slow"])])
    assert out["slow"].status == "FAILED" and out["slow"].seconds < 1 and out["next"].status == "BLOCKED"


def test_scratch_is_cleared(spark, tmp_path):
    import os

    from tarnlake import session

    df = session.materialize(spark.range(3), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path) and session.clear_scratch(spark) > 0 and not os.path.exists(path)


def test_a_view_is_built_again_only_for_another_mark(spark, tmp_path):
    from tarnlake.operators.views import Materialized

    v = Materialized(Versioned(spark, str(tmp_path / "v")))
    assert v.refresh("1", lambda: spark.range(2)) and not v.refresh("1", lambda: spark.range(5))
    assert v.read().count() == 2 and v.refresh("2", lambda: spark.range(5)) and v.read().columns == ["id"]
