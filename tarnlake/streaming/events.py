"""The streaming path: decode, late flag, dedup, windows, idempotent sinks, reconciliation, stateful promises."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlake.operators.buckets import Bucketed
from tarnlake.operators.merge import insert_only, latest
from tarnlake.operators.tables import Versioned

CONTACT = "contact_id string, loan_id string, customer_id string, event_time timestamp, collector_id string, channel_code string, contact_direction string, contact_outcome string, is_rpc_flag boolean, call_duration_seconds int, complaint_flag boolean, source_system string"
WATERMARK = "30 minutes"


def decode(raw: DataFrame, schema: str = CONTACT, body: str = "body", ingested: str = "ingestion_time") -> DataFrame:
    """JSON bodies as columns, beside the time of arrival."""
    return raw.select(F.from_json(F.col(body).cast("string"), schema).alias("event"), F.col(ingested)).select("event.*", ingested)


def file_source(spark: SparkSession, path: str, schema, file_format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(file_format)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def flag_late(df: DataFrame, event: str = "event_time", ingested: str = "ingestion_time", by: str = WATERMARK) -> DataFrame:
    """``late_arrival`` for rows older than the allowance at arrival; all rows stay."""
    return df.withColumn("late_arrival", F.col(event) < F.col(ingested) - F.expr(f"INTERVAL {by}"))


def dedup(df: DataFrame, key: list[str], event: str = "event_time", watermark: str = WATERMARK) -> DataFrame:
    """One row for each key within the watermark; state is dropped beyond it."""
    return df.withWatermark(event, watermark).dropDuplicatesWithinWatermark(key)


def windowed(df: DataFrame, keys: list[str], aggregates: list, event: str = "event_time", size: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    w = F.window(event, size, slide) if slide else F.window(event, size)
    g = df.withWatermark(event, watermark).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *g.columns[1:])


def sessions(df: DataFrame, keys: list[str], event: str = "event_time", gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    g = df.withWatermark(event, watermark).groupBy(F.session_window(event, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that is safe to replay: each batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All batches of an append sink; columns that came later are null in earlier rows."""
    return spark.read.option("mergeSchema", True).parquet(path)


def complete_sink(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of whole results (output mode complete) as versions of a table: who reads one (``tables.Versioned``) keeps it
    while the next is written. A batch that is run again writes its version again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = Versioned(batch.sparkSession, path)
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        table.vacuum(keep)

    return write


def bucket_sink(table: Bucketed, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch insert-only merge into buckets: the latest row of each new key, known keys left alone.

    Only the buckets of the batch's keys are read, whatever the table has gathered, and a batch that is run again writes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = latest(batch, table.key, [F.col(c).desc() for c in order]).persist()
        try:
            if new.isEmpty():
                return
            if table.versions():
                table.merge(new, lambda held, rows: insert_only(held, rows, table.key))
            else:
                table.create(new)
        finally:
            new.unpersist()

    return write


def merge_sink(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch insert-only merge: the latest row of each new key, known keys left alone. Replays add nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        new = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).where("_rn = 1").drop("_rn")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            held = spark.read.parquet(path).where(F.col("batch_id") != batch_id).select(*key)
            new = new.join(held, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """A query with its own checkpoint: by a processing-time trigger, or over what is there now."""
    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def reconcile(bronze: DataFrame, silver: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Late rows that the merged table does not have yet, each key once."""
    late = bronze.where("late_arrival").withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).where("_rn = 1").drop("_rn")
    return late.join(silver.select(*key), key, "left_anti")


def has_data(df: DataFrame, column: str, mark) -> bool:
    """Whether rows lie beyond a high-water mark; asking consumes nothing."""
    return not (df if mark is None else df.where(F.col(column) > F.lit(mark))).isEmpty()


def missing_data(df: DataFrame, keys: list[str], ts: str, as_of, hours: int) -> DataFrame:
    """The sources (``keys``) whose last row is more than ``hours`` before ``as_of``: keys, last, hours_since."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("last"))
    since = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 3600
    return last.withColumn("hours_since", since).where(F.col("hours_since") > hours)


def track_promises(events: DataFrame, key: str = "loan_id", watermark: str = WATERMARK) -> DataFrame:
    """Promises kept or broken, as a stateful stream.

    Rows are (key, kind promise|payment, amount, event_time, due). A key holds one open promise; payments
    count towards it; it is Kept once they reach its amount, and Partial or Broken when the watermark passes its due time.
    """

    def step(keys, rows, state: GroupState):
        out = []
        amount, paid, due = state.get if state.exists else (0.0, 0.0, 0)
        if state.hasTimedOut:
            out.append((keys[0], "Partial" if paid > 0 else "Broken", amount, paid))
            state.remove()
        else:
            for r in pd.concat(list(rows)).sort_values(["event_time", "kind"]).itertuples():
                if r.kind == "promise":
                    if amount:
                        out.append((keys[0], "Partial" if paid > 0 else "Broken", amount, paid))
                    amount, paid, due = float(r.amount), 0.0, int(r.due.timestamp() * 1000)
                elif amount:
                    paid += float(r.amount)
                    if paid >= amount:
                        out.append((keys[0], "Kept", amount, paid))
                        amount, paid, due = 0.0, 0.0, 0
            if amount:
                state.update((amount, paid, due))
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "status", "amount", "paid"])

    return (
        events.withWatermark("event_time", watermark)
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} string, status string, amount double, paid double", "amount double, paid double, due long", "append", GroupStateTimeout.EventTimeTimeout)
    )
