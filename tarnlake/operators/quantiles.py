"""Exact quantiles of many groups at once, without sorting and without one task that holds a group's values.

Selection by digits: each wanted rank looks at an interval of values, at first its group's whole range. A pass counts the rows in
``BINS`` even bins of every open interval; the bin that holds the rank, cut down to its least and greatest value, is the next
interval. The ranks of one interval share its counts. An interval of one value is done, and one of few rows is sorted. Counts are summed up
before they are shuffled, so no task holds more than the bins of one interval, and the intervals alone (a few for each group) come back to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import materialize

BINS, LEAF = 4096, 4096
#: Intervals that are broadcast to the rows at most; beyond it they are joined by a shuffle.
BROADCAST_INTERVALS = 50_000


def exact_quantiles(df: DataFrame, group: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """One row for each group and probability: the group, p, and the linearly interpolated ``value``.

    Values are compared as doubles. Nulls, NaN and infinities are left out; a group without other values has no row. Null group
    columns are a group; without group columns all rows are one. An empty table gives no rows.
    """
    names = [f"_g{i}" for i in range(len(group))]
    v = F.col(column).cast("double")
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, names)], v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    whole = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    at = whole.select("*", ps).withColumn("x", F.col("p") * (F.col("n") - 1))
    ends = F.explode(F.array(F.floor("x"), F.ceil("x"))).alias("rank")
    # rank: the value's place within the interval, from 0; share: of the way from the lower to the upper value.
    targets = materialize(at.select(*names, "p", (F.col("x") - F.floor("x")).alias("share"), "lo", "hi", "n", ends, F.floor("x").alias("base")).withColumn("upper", F.col("rank") > F.col("base")).withColumn("rank", F.col("rank").cast("long")).drop("base").distinct(), "quantiles")
    done = []
    while True:
        closed = F.col("lo") == F.col("hi")
        done.append(targets.where(closed).select(*names, "p", "share", "upper", F.col("lo").alias("v")))
        small, wide = targets.where(~closed & (F.col("n") <= LEAF)), targets.where(~closed & (F.col("n") > LEAF))
        if not small.isEmpty():
            own = _within(rows, small, names)
            order = F.row_number().over(Window.partitionBy(*[f"{n}r" for n in names], "_lo", "_hi").orderBy("v")) - 1
            hit = small.join(own.withColumn("_rank", order), _interval(names) & (F.col("rank") == F.col("_rank")))
            done.append(materialize(hit.select(*names, "p", "share", "upper", "v"), "quantiles"))
        if wide.isEmpty():
            break
        # Halves, so that the width of a span never overflows.
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BINS)).cast("int")
        span = [*[f"{n}r" for n in names], "_lo", "_hi"]
        counted = _within(rows, wide, names).groupBy(*span, place.alias("_bin")).agg(F.count("*").alias("_n"), F.min("v").alias("_least"), F.max("v").alias("_most"))
        upto = F.sum("_n").over(Window.partitionBy(*span).orderBy("_bin"))
        binned = counted.withColumn("_before", upto - F.col("_n"))
        hit = wide.join(binned, _interval(names) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        targets = materialize(hit.select(*names, "p", "share", "upper", F.col("_least").alias("lo"), F.col("_most").alias("hi"), F.col("_n").alias("n"), (F.col("rank") - F.col("_before")).alias("rank")), "quantiles")
    found = reduce(DataFrame.unionByName, done)
    # Where a rank falls on a row there is no upper value.
    each = found.groupBy(*names, "p").agg(F.max("share").alias("share"), F.max(F.when(~F.col("upper"), F.col("v"))).alias("a"), F.max(F.when(F.col("upper"), F.col("v"))).alias("b"))
    value = F.col("a") + F.coalesce((F.col("b") - F.col("a")) * F.col("share"), F.lit(0.0))
    return each.select(*[F.col(n).alias(c) for c, n in zip(group, names)], "p", value.alias("value"))


def _interval(names: list[str]) -> Column:
    """A target's interval is a row's."""
    return reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names], F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi")))


def _within(rows: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """Each row with the interval of its group that holds it (intervals of a group are equal or apart): group names with an r, v, _lo, _hi."""
    spans = targets.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_INTERVALS else spans
    own = rows.select(*[F.col(n).alias(f"{n}r") for n in names], "v")
    on = reduce(lambda x, y: x & y, [F.col(f"{n}r").eqNullSafe(F.col(f"{n}s")) for n in names], (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")))
    return own.join(spans, on).drop(*[f"{n}s" for n in names])


def outliers(df: DataFrame, group: list[str], column: str, factor: float = 3.0) -> DataFrame:
    """The rows beyond the quartiles widened by ``factor`` of their distance, within their group."""
    q = exact_quantiles(df, group, column, [0.25, 0.75])
    b = q.groupBy(*group).agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    b = b.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("_lo"), (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("_hi"))
    on = reduce(lambda x, y: x & y, [df[g].eqNullSafe(b[f"_g{i}"]) for i, g in enumerate(group)], F.lit(True))
    return df.join(b, on & ((df[column] < b["_lo"]) | (df[column] > b["_hi"]))).select(*df.columns)
