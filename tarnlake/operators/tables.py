"""Parquet tables with versions: new content goes to a new folder, and the newest complete one holds.

A path that is being read is never overwritten, so a failed job leaves the table as it was, old versions can be
read again, and clearing is a separate step. The pointer is the highest version whose
writer has left its success mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs_path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions: those whose writer left its mark."""
        if not self._fs.exists(self._fs_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(self.path))]
        done = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(v for v in done if self._fs.exists(self._fs_path(f"{self.path}/v={v}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.versions())

    def write(self, df: DataFrame, partition_by: list[str] | None = None, **options: str) -> int:
        v = max(self.versions(), default=-1) + 1
        w = df.write.mode("overwrite").options(**options)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/v={v}")
        return v

    def read(self, version: int | None = None) -> DataFrame:
        held = self.versions()
        v = held[-1] if version is None else version
        if v not in held:
            raise ValueError(f"{self.path} has no version {v}")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/v={v}")

    def restore(self, version: int) -> int:
        """Make an old version hold again, as a new one."""
        return self.write(self.read(version))

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete all but the newest versions; returns those deleted."""
        old = self.versions()[: -max(1, keep)]
        for v in old:
            self._fs.delete(self._fs_path(f"{self.path}/v={v}"), True)
        return old

    def compact(self, columns: list[str], files: int, zorder: bool = False) -> int:
        """Rewrite into fewer files, clustered by the columns."""
        df = self.read()
        if zorder and len(columns) == 2:
            clustered = df.withColumn("_z", interleave(*[bits(df, c) for c in columns])).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
        else:
            clustered = df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)
        return self.write(clustered)


def bits(df: DataFrame, column: str, width: int = 16) -> Column:
    """A column's place among ``2 ** width`` even steps between its least and greatest value."""
    lo, hi = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    span = (hi - lo) if lo is not None and hi != lo else 1.0
    return F.coalesce(F.floor((F.col(column).cast("double") - F.lit(lo or 0.0)) / F.lit(span) * (2**width - 1)), F.lit(0)).cast("long")


def interleave(a: Column, b: Column, width: int = 16) -> Column:
    """The bits of two numbers in turn."""
    out = F.lit(0).cast("long")
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + 1)).bitwiseOR(F.shiftleft(F.shiftright(b, k).bitwiseAND(F.lit(1).cast("long")), 2 * k))
    return out


def analyze(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def expire(df: DataFrame, day: str, days: int, today: Column) -> DataFrame:
    """Rows still within a table's retention."""
    return df.where(F.col(day) >= F.date_sub(today, days))


#: Writer options for point lookups on a column: a row group's filter is made for ``distinct`` values, of which ``wrong`` is the share of absent ones that pass it.
def lookup_options(column: str, distinct: int = 1_000_000, wrong: float = 0.01) -> dict[str, str]:
    own = {"enabled": "true", "expected.ndv": str(distinct), "fpp": str(wrong)}
    return {f"parquet.bloom.filter.{name}#{column}": value for name, value in own.items()}
