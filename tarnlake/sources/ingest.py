"""Contract-driven ingestion: drift class, audit columns, quarantine split, control log."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnlake.sources.contracts import Contract, classify
from tarnlake.sources.landing import headers, read_partition

LOG = "table_name string, batch_id string, start_ts timestamp, end_ts timestamp, status string, detail string, row_count long, quarantined_count long"


def batch_id(table: str, date: str) -> str:
    """The same for a replay of the same date."""
    return hashlib.md5(f"{table}|{date}".encode()).hexdigest()


def conform(raw: DataFrame, contract: Contract, renamed: dict[str, str]) -> DataFrame:
    """Contract names and types; what does not parse is null and named in ``_bad_columns``; extra columns stay as text."""
    for old, new in renamed.items():
        raw = raw.withColumnRenamed(old, new)
    schema = contract.schema()
    typed, bad = [], []
    for f in schema.fields:
        if f.name in raw.columns:
            c = F.col(f.name)
            typed.append(c.try_cast(f.dataType).alias(f.name))
            bad.append(F.when(c.isNotNull() & (F.trim(c.cast("string")) != "") & c.try_cast(f.dataType).isNull(), F.lit(f.name)))
        else:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in raw.columns if c not in contract.columns]
    return raw.select(*typed, *extra, F.array_compact(F.array(*bad) if bad else F.array().cast("array<string>")).alias("_bad_columns"))


def ingest(spark: SparkSession, contract: Contract, date: str, bronze: str, quarantine: str, log: str, corrupt: Column | None = None) -> dict:
    """Land one date: write clean and quarantined rows, replacing that date's partition, and log the run.

    A replay writes the same rows to the same partition. ``corrupt`` marks rows for quarantine besides those
    without a key or with a value that does not parse; a breaking drift sends the whole batch there.
    """
    start, batch = datetime.now(timezone.utc), batch_id(contract.table, date)
    raw = read_partition(spark, contract, date)
    if raw is None:
        return _log(spark, log, contract.table, batch, start, "NO_FILE_LANDED", "", 0, 0)
    drift = classify(contract, [c for c in raw.columns if c != contract.partition])
    rows = conform(raw.drop(contract.partition), contract, drift.renamed)
    no_key = F.lit(False)
    for k in contract.natural_key:
        no_key = no_key | F.col(k).isNull()
    suspect = F.lit(drift.kind == "breaking") | no_key | (F.size("_bad_columns") > 0)
    if corrupt is not None:
        suspect = suspect | F.coalesce(corrupt, F.lit(False))
    audited = rows.select("*", F.lit(batch).alias("_batch_id"), F.current_timestamp().alias("_ingestion_ts"), F.lit(contract.path.format(date=date)).alias("_source_file"), F.lit(date).alias("_ingestion_date"), suspect.alias("_is_quarantined"), F.lit(drift.kind).alias("_schema_drift_classification"))
    # Both sides and their counts come from one reading of the landed files.
    audited = audited.persist()
    counts = []
    try:
        for target, keep in ((bronze, ~F.col("_is_quarantined")), (quarantine, F.col("_is_quarantined"))):
            path, seen, whole = f"{target}/{contract.table}", Observation(), contract.strategy == "full_snapshot_overwrite"
            rows = audited.where(keep).drop("_bad_columns" if target == bronze else "_none").observe(seen, F.count(F.lit(1)).alias("n"))
            # The date's partition, or the whole table, is written aside and then takes the old one's place; a replay may have no row for this side.
            new = f"{path}/.new-{uuid.uuid4().hex}" if not whole else f"{target}/.new-{uuid.uuid4().hex}"
            (rows.write if whole else rows.write.partitionBy("_ingestion_date")).parquet(new)
            own = path if whole else f"{path}/_ingestion_date={date}"
            recover(spark, own)
            replace(spark, new if whole else f"{new}/_ingestion_date={date}", own)
            _drop(spark, new)
            counts.append(seen.get["n"])
    finally:
        audited.unpersist()
    n, q = counts
    detail = f"added={','.join(drift.added)} missing={','.join(drift.missing)} renamed={','.join(drift.renamed)}"
    return _log(spark, log, contract.table, batch, start, "BREAKING_DRIFT" if drift.kind == "breaking" else "SUCCESS", detail, n, q)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _aside(path: str) -> str:
    parent, name = path.rsplit("/", 1)
    return f"{parent}/.aside-{name}"


def replace(spark: SparkSession, new: str, final: str) -> None:
    """Put a written folder in the place of another, by renames alone; where nothing was written the old one goes.

    The old folder waits aside until the new one is in place, so a crash loses neither: ``recover`` puts it back.
    """
    if _exists(spark, final):
        _rename(spark, final, _aside(final))
    if _exists(spark, new):
        _rename(spark, new, final)
    _drop(spark, _aside(final))


def recover(spark: SparkSession, final: str) -> bool:
    """End what a crash in ``replace`` left: the old folder comes back if the new one never came. Whether there was anything to end."""
    aside = _aside(final)
    if not _exists(spark, aside):
        return False
    if _exists(spark, final):
        _drop(spark, aside)
    else:
        _rename(spark, aside, final)
    return True


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _path(spark, old)
    fs.mkdirs(_path(spark, new.rsplit("/", 1)[0])[1])
    if not fs.rename(p, _path(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def ingest_day(spark: SparkSession, contracts: dict[str, Contract], date: str, bronze: str, quarantine: str, log: str) -> list[dict]:
    """Land one date of every table of a registry; a table whose files are absent is logged and does not stop the others."""
    return [ingest(spark, c, date, bronze, quarantine, log) for _, c in sorted(contracts.items())]


def drift_report(spark: SparkSession, contract: Contract, paths: list[str]) -> DataFrame:
    """(path, kind, added, missing, renamed) of CSV files against a contract, from their headers alone."""
    rows = []
    for path, names in sorted(headers(spark, paths).items()):
        d = classify(contract, [c for c in names if c != contract.partition])
        rows.append((path, d.kind, d.added, d.missing, [f"{a}>{b}" for a, b in sorted(d.renamed.items())]))
    return spark.createDataFrame(rows, "path string, kind string, added array<string>, missing array<string>, renamed array<string>")


def _log(spark, log, table, batch, start, status, detail, n, q) -> dict:
    row = (table, batch, start, datetime.now(timezone.utc), status, detail, n, q)
    spark.createDataFrame([row], LOG).write.mode("append").parquet(log)
    return dict(zip([c.split()[0] for c in LOG.split(", ")], row))


def high_water(df: DataFrame, column: str):
    """The greatest value taken so far, or None."""
    return df.agg(F.max(column)).first()[0]


def since(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows beyond a high-water mark; asking does not consume them."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))
