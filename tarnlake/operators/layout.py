"""Files laid out along a Z-order of ranks, and what a scan has read of them.

A column's place on the curve is its rank among cut points taken from a bounded sample, not its value: outliers and uneven values do not spoil
it, and dates, numbers and texts lie on one scale. The bits of all ranks in turn give the curve, so a file holds a box of every column.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the cut points are taken from at most, and bits of a rank.
SAMPLE, BITS = 20_000, 6


def cut_points(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list]:
    """At most ``2 ** bits - 1`` rising cut points for each column, from a sample of at most about ``SAMPLE`` rows."""
    n = df.count()
    share = min(1.0, SAMPLE / n) if n else 1.0
    rows = (df.select(*columns) if share == 1 else df.select(*columns).sample(share, seed=7)).collect()
    out = {}
    for c in columns:
        values, steps = sorted(v for v in (r[c] for r in rows) if v is not None), 2**bits
        out[c] = sorted({values[len(values) * k // steps] for k in range(1, steps)}) if values else []
    return out


def rank(column: str, cuts: list) -> Column:
    """How many cut points lie at or below a value, by a tree of comparisons; a null has rank 0."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= F.lit(cuts[mid]), within(mid + 1, hi)).otherwise(within(lo, mid))

    return within(0, len(cuts)).cast("long")


def z_order(columns: list[Column], bits: int = BITS) -> Column:
    """The bits of several numbers in turn, the highest first."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + len(columns) - 1 - i))
    return out


def clustered(df: DataFrame, columns: list[str], files: int, bits: int = BITS) -> DataFrame:
    """The rows dealt to ``files`` partitions along the curve and sorted along it; 10 columns of 6 bits fit into its number."""
    if len(columns) * bits > 62:
        raise ValueError("too many columns for that many bits")
    cuts = cut_points(df, columns, bits)
    ranked = df.withColumns({f"_r{i}": rank(c, cuts[c]) for i, c in enumerate(columns)})
    along = ranked.withColumn("_z", z_order([F.col(f"_r{i}") for i in range(len(columns))], bits))
    return along.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z", *[f"_r{i}" for i in range(len(columns))])


def write(df: DataFrame, path: str, columns: list[str], files: int, group_bytes: int = 8 << 20) -> None:
    """Clustered Parquet files; ``group_bytes`` is the size of a row group, whose least and greatest values let a scan skip it."""
    clustered(df, columns, files).write.option("parquet.block.size", group_bytes).parquet(path)


def rows_read(df: DataFrame) -> tuple[list, int]:
    """(the rows of a small result, how many rows its scans have read from their files), by the scan's own metrics."""
    rows = df.collect()
    plan, total, nodes = df._jdf.queryExecution().executedPlan(), 0, []
    nodes.append(plan)
    while nodes:
        p = nodes.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(p.plan())
        elif name == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows, int(total)


def place(cuts: list, value) -> int:
    """The rank of one value."""
    return bisect.bisect_right(cuts, value) if value is not None else 0
