"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tarnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the library's queries expect (UTC, adaptive execution)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all run in one process, a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tarnlake-')}")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; ``clear_scratch`` deletes it."""
    path = f"{shared_dir(spark)}/tarnlake-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder whose content is not read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    held = _made.get(spark.sparkContext.applicationId, [])
    if path in held:
        held.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to scratch; call it once no result is to be read any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_scratch(spark, path)
    return len(paths)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
