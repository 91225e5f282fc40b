import datetime as dt

from pyspark.sql import functions as F

from tarnlake.streaming import events as S

SCHEMA = "contact_id string, event_time timestamp, ingestion_time timestamp, v int"


def T(minute):
    return dt.datetime(2025, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def land(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_merge_sink_inserts_once_and_matches_batch(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    land(spark, src, [[("a", T(0), T(1), 1), ("a", T(2), T(3), 2), ("b", T(1), T(90), 3)]])
    df = S.flag_late(S.file_source(spark, src, SCHEMA, "parquet"))
    for _ in range(2):
        S.start(df, S.merge_sink(out, ["contact_id"], ["event_time"]), str(tmp_path / "cp")).awaitTermination()
    land(spark, src, [[("a", T(5), T(5), 9), ("c", T(5), T(5), 4)]])
    S.start(df, S.merge_sink(out, ["contact_id"], ["event_time"]), str(tmp_path / "cp")).awaitTermination()
    got = {r.contact_id: (r.v, r.late_arrival) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (2, False), "b": (3, True), "c": (4, False)}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", T(0), T(0), 1)], SCHEMA)
    for sink in (S.append_sink(out), S.merge_sink(str(tmp_path / "m"), ["contact_id"], ["event_time"])):
        sink(df, 0)
        sink(df, 0)
    assert spark.read.parquet(out).count() == 1 and spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_dedup_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    land(spark, src, [[("a", T(0), T(0), 1), ("a", T(0), T(0), 1), ("b", T(70), T(70), 2), ("c", T(200), T(200), 3)]])
    df = S.file_source(spark, src, SCHEMA, "parquet")

    def run(q, name):
        out = str(tmp_path / name)
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(q.schema).parquet(out)

    assert run(S.dedup(df, ["contact_id"]), "d").count() == 3
    w = run(S.windowed(df, [], [F.count("*").alias("n")]), "w")
    assert sorted((r.window_start.hour, r.n) for r in w.collect()) == [(0, 2), (1, 1)]
    s = run(S.sessions(df, ["contact_id"]), "s")
    assert sorted((r.contact_id, r.events) for r in s.collect()) == [("a", 2), ("b", 1)]


def test_reconcile_and_gate(spark):
    bronze = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("b", 2, True), ("c", 1, False)], "k string, ts int, late_arrival boolean")
    assert [(r.k, r.ts) for r in S.reconcile(bronze, bronze.where("k = 'a'"), ["k"], ["ts"]).collect()] == [("b", 2)]
    assert S.has_data(bronze, "ts", 1) and not S.has_data(bronze, "ts", 2) and S.has_data(bronze, "ts", None)


def test_promises_are_kept_or_time_out(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "loan_id string, kind string, amount double, event_time timestamp, due timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("x", "promise", 10.0, T(0), T(60)), ("y", "promise", 5.0, T(0), T(60))])
    q = S.track_promises(S.file_source(spark, src, schema, "parquet"))

    def go():
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    go()
    put([("x", "payment", 10.0, T(30), None), ("z", "payment", 1.0, T(300), None)])
    go()
    put([("z", "payment", 1.0, T(301), None)])
    go()
    assert sorted((r.loan_id, r.status) for r in spark.read.schema(q.schema).parquet(out).collect()) == [("x", "Kept"), ("y", "Broken")]


def test_bodies_decode(spark):
    raw = spark.createDataFrame([('{"contact_id": "a", "is_rpc_flag": true}', T(0)), ("junk", T(0))], "body string, ingestion_time timestamp")
    assert [(r.contact_id, r.is_rpc_flag) for r in S.decode(raw).collect()] == [("a", True), (None, None)]
