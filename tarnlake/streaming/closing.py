"""Windows whose state ends, and what comes too late for them.

A first stream parts each batch: a row whose windows have all ended, by the times of the batches before it, goes to a side
output, every other row to a staged folder. A second stream aggregates the staged rows in append mode: a window comes out once, when the
watermark has passed its end, and its state is dropped. As the second stream is never ahead of the first, it drops no row: each row is in a window or in the side output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.streaming import events as streams

_MARKS = "batch_id long, mark timestamp"


def last_end(event: str, size: str, slide: str | None = None) -> Column:
    """The end of the last window that holds a time."""
    every = slide or size
    return F.window(event, every).getField("start") + F.expr(f"interval {size}")


def part_late(staged: str, late: str, marks: str, ends: Column, event: str = "event_time", watermark: str = streams.WATERMARK) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that parts a batch, safe to replay: a batch looks at the marks of earlier batches alone and replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _marks(spark, marks).where(F.col("batch_id") < batch_id).agg(F.max("mark")).first()[0]
        is_late = F.lit(False) if before is None else F.coalesce(ends <= F.lit(before).cast("timestamp") - F.expr(f"interval {watermark}"), F.lit(True))
        held = batch.withColumn("_late", is_late)
        for path, keep in ((staged, ~F.col("_late")), (late, F.col("_late"))):
            held.where(keep).drop("_late").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(F.col(event).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{marks}/of={batch_id}")

    return write


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _MARKS)
    return spark.read.schema(_MARKS).parquet(f"{path}/of=*")


def staged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stream of rows that came in time."""
    return spark.readStream.schema(schema).parquet(f"{path}/batch_id=*")


def state_rows(query) -> int:
    """How many rows of state a stream holds after its last batch."""
    return sum(op.get("numRowsTotal", 0) for op in (query.lastProgress or {}).get("stateOperators", []))


def dropped_rows(query) -> int:
    """How many rows the watermark has dropped in all of a stream's batches."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))
