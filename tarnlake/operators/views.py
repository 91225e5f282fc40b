"""Tables made from queries, views, and materialised views that know what they were built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.tables import Versioned


def replace_table(df: DataFrame, name: str, path: str) -> None:
    """CREATE OR REPLACE TABLE AS, with its files in a new ``path``: a table that is being read stays whole."""
    spark = df.sparkSession
    df.write.parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")


def replace_view(df: DataFrame, name: str) -> None:
    """CREATE OR REPLACE VIEW of the session; it is computed where it is read."""
    df.createOrReplaceTempView(name)


class Materialized:
    """A stored result with the mark of its inputs (a batch id, a high-water mark): it is built again only for another mark."""

    MARK = "_source_mark"

    def __init__(self, table: Versioned):
        self.table = table

    def mark(self) -> str | None:
        """The mark that it was built from; None where it has no rows, and is built again."""
        row = self.table.read().select(self.MARK).first() if self.table.exists() else None
        return row[0] if row else None

    def refresh(self, mark: str, build: Callable[[], DataFrame]) -> bool:
        """Whether it had to be built."""
        if self.mark() == mark:
            return False
        self.table.write(build().withColumn(self.MARK, F.lit(mark)))
        return True

    def read(self) -> DataFrame:
        return self.table.read().drop(self.MARK)
