"""A change feed between versions of a keyed table, read by consumers with marks of their own.

What a consumer has not seen is the difference between the version at its mark and the newest one. Asking moves nothing: the mark
moves when the consumer commits, so a consumer that fails sees the same rows again, and two consumers do not disturb each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.buckets import Bucketed


def changes_between(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``_change``: insert, delete, update_before and update_after, by key (null-safe) and the hash of the row.

    Keys are unique on either side. Only keys and hashes are compared to find what moved; a row that is equal on both sides appears nowhere.
    """
    row = lambda df: F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    a = old.select(F.struct(*key).alias("_k"), row(old).alias("_h"), F.struct(*old.columns).alias("_old"))
    b = new.select(F.struct(*key).alias("_k"), row(new).alias("_h"), F.struct(*new.columns).alias("_new"))
    j = a.alias("a").join(b.alias("b"), F.col("a._k").eqNullSafe(F.col("b._k")), "full_outer").where(~F.col("a._h").eqNullSafe(F.col("b._h")))
    gone, came = F.col("a._h").isNotNull(), F.col("b._h").isNotNull()
    mark = lambda name, rows: F.struct(F.lit(name).alias("_change"), F.col(rows).alias("row"))
    both = F.array(mark("update_before", "_old"), mark("update_after", "_new"))
    out = j.select(F.explode(F.when(gone & came, both).when(came, F.array(mark("insert", "_new"))).otherwise(F.array(mark("delete", "_old")))).alias("c"))
    return out.select("c._change", "c.row.*")


class Consumer:
    """One reader of a table's changes. Its marks are empty files named by version; the highest holds."""

    def __init__(self, table: Bucketed, name: str):
        self.table, self.folder = table, f"{table.path}/consumers/{name}"

    def mark(self) -> int | None:
        """The version up to which all is consumed; None before the first commit."""
        at = self.table._p(self.folder)
        if not self.table._fs.exists(at):
            return None
        return max((int(s.getPath().getName()[2:]) for s in self.table._fs.listStatus(at)), default=None)

    def has_data(self) -> bool:
        """Whether any bucket differs from what was consumed; answered from two manifests, and nothing moves."""
        held, mark = self.table.versions(), self.mark()
        return bool(held) and (mark is None or bool(self.table.changed_buckets(mark, held[-1])))

    def pending(self) -> tuple[DataFrame, int]:
        """(the changes since the mark, the version to commit). Only buckets that differ are read; before the first commit every row is an insert."""
        newest, mark = self.table.versions()[-1], self.mark()
        if mark is None:
            rows = self.table.read(newest)
            return rows.select(F.lit("insert").alias("_change"), *rows.columns), newest
        only = self.table.changed_buckets(mark, newest)
        return changes_between(self.table.read(mark, only), self.table.read(newest, only), self.table.key), newest

    def commit(self, version: int) -> None:
        """All up to ``version`` is consumed. A mark never goes back."""
        if self.mark() is not None and version < self.mark():
            raise ValueError(f"the mark is at {self.mark()}")
        self.table._fs.create(self.table._p(f"{self.folder}/v={version}"), True).close()


def replay(state: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """A copy of the table brought up to date by a feed."""
    gone = feed.where("_change in ('delete', 'update_before')").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    on = reduce(lambda a, b: a & b, [state[k].eqNullSafe(gone[f"_k{i}"]) for i, k in enumerate(key)])
    return state.join(gone, on, "left_anti").unionByName(feed.where("_change in ('insert', 'update_after')").drop("_change"))
