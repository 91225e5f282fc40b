"""Joins over time whose cost is the sum of both sides, however many rows one key has.

Rows go by key and bucket of time. What a bucket needs from earlier ones, the last right row before it, is carried in a
small pass over one head for each key and bucket, so a hot key is dealt out over its buckets and no task holds all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(c: Column, kind: str) -> Column:
    """Microseconds that rise with a time, whatever the session's zone: times without a zone are taken by their own date and clock."""
    if kind != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return clock * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def bucket_of(ts: str, seconds: int, kind: str = "timestamp") -> Column:
    """The number of a time's bucket; null for a null time."""
    return F.floor(micros(F.col(ts), kind) / F.lit(seconds * 1_000_000)).cast("long")


def asof_join_bucketed(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, take: list[str], seconds: int, tiebreak: list[str] | None = None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, as ``temporal.asof_join`` gives it.

    A task holds the rows of one key in one bucket of ``seconds``, and one carried row; the carrying pass holds one row for each
    bucket of a key. A left row without a time matches nothing, a right row without one is never taken. Equal times go to the last by ``tiebreak``.
    """
    kind, ties = dict(left.dtypes)[left_ts], tiebreak or []
    r = right.where(F.col(right_ts).isNotNull()).select(*key, F.col(right_ts).cast(kind).alias("_ts"), F.struct(*take).alias("_r"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    r = r.withColumn("_bucket", bucket_of("_ts", seconds, kind))
    l_ = left.select(*key, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l")).withColumn("_bucket", bucket_of("_ts", seconds, kind))
    order = F.struct("_ts", *[f"_t{i}" for i in range(len(ties))])
    heads = r.groupBy(*key, "_bucket").agg(F.max_by("_r", order).alias("_head"))
    asked = l_.where("_bucket is not null").select(*key, "_bucket", F.lit(True).alias("_asked")).distinct()
    each = heads.unionByName(asked, allowMissingColumns=True).groupBy(*key, "_bucket").agg(F.any_value("_head", ignoreNulls=True).alias("_head"), F.bool_or("_asked").alias("_asked"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_r", F.last("_head", ignorenulls=True).over(before)).where("_asked and _r is not null").select(*key, "_bucket", "_r", F.lit(0).alias("_side"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [l_.withColumn("_side", F.lit(2)), r.withColumn("_side", F.lit(1)), carried])
    # A carried row has no time of its own: it comes first.
    w = Window.partitionBy(*key, "_bucket").orderBy(F.col("_ts").asc_nulls_first(), "_side", *[f"_t{i}" for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 2")
    timed = F.col("_bucket").isNotNull()
    return found.select("_l.*", *[F.when(timed, F.col("_m")[c]).alias(prefix + c) for c in take])


def pit_join_bucketed(facts: DataFrame, versions: DataFrame, fact_key: str, version_key: str, at: str, seconds: int, start: str = "effective_start", end: str = "effective_end", how: str = "inner") -> DataFrame:
    """The version in force at each fact's time, for versions of a key that do not overlap (an SCD2 history).

    Of such versions only the last that starts at or before the time can hold, so one as-of join and a look at its end do, and a key
    with many facts and versions costs their sum. A version without an end holds for ever. ``how`` is inner or left; names that both sides have are not allowed.
    """
    taken = [c for c in versions.columns if c != version_key]
    v = versions.withColumnRenamed(version_key, "_key").where(F.col("_key").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    f = facts.withColumn("_key", F.col(fact_key))
    j = asof_join_bucketed(f, v, ["_key"], at, start, [*taken, "_key"], seconds, prefix="_v_")
    holds = F.col("_v__key").isNotNull() & (F.col(f"_v_{end}").isNull() | (F.col(at) < F.col(f"_v_{end}")))
    cols = [F.when(holds, F.col(f"_v_{c}")).alias(c) for c in taken]
    out = j.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    own = F.when(holds, F.col("_v__key")).alias(version_key)
    return (out.where("_holds") if how == "inner" else out).select(*facts.columns, *([own] if version_key not in facts.columns else []), *cols)


def range_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, seconds: int, step: int = 8) -> DataFrame:
    """Every (point, span) of one key with ``start <= at < end``, for spans that may overlap and be of any length.

    Bins of level k are ``seconds * step ** k`` wide. A span lies on the first level whose bins are as wide as it is, in the two bins that it
    touches at most; a point looks into its one bin of every level that has spans. So a row is repeated at most twice, or as often as
    there are levels, and a join's group holds what shares a bin. ``key`` names are in both; other names must differ. Rows with nulls in key or time match nothing.
    """
    kinds = {**dict(spans.dtypes), **dict(points.dtypes)}
    micro = lambda c: micros(F.col(c), kinds[c])
    s = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    s = s.withColumn("_lo", micro(start)).withColumn("_hi", micro(end) - 1)
    wide = F.ceil(F.log(float(step), F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.lit(seconds * 1e6))) - F.lit(1e-9))
    s = s.withColumn("_level", F.greatest(F.lit(0), wide).cast("int"))
    size = lambda level: (F.lit(seconds * 1_000_000).cast("double") * F.pow(F.lit(float(step)), level)).cast("long")
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / size(F.col("_level"))), F.floor(F.col("_hi") / size(F.col("_level"))))))
    # A level's bins are step times wider than those of the level before: there are as many as the longest span needs, some twenty.
    levels = [r[0] for r in s.select("_level").distinct().collect()] or [0]
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).withColumn("_bin", F.floor(micro(at) / size(F.col("_level"))))
    j = p.join(s, [*key, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return j.drop("_level", "_bin", "_lo", "_hi")


def open_totals(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, sums: list[str], seconds: int, count: str = "n") -> DataFrame:
    """Each point with how many spans of its key hold at its time (``start <= at < end``) and the sums of their columns, at the cost of both sides' rows.

    A span adds its values where it starts and takes them back where it ends, so what holds at a time is a running sum and no pair is made. A task holds
    the times of one key in one bucket of ``seconds``, and one carried row of what holds when the bucket begins. ``sums`` are whole numbers or decimals; nulls
    count as zero, and so do sums over no span. Rows with nulls in key or time match nothing. Names of ``points`` and ``sums`` must differ.
    """
    kind, names = dict(points.dtypes)[at], [f"_s{i}" for i in range(len(sums) + 1)]
    held = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    side = lambda c, sign: held.select(*key, F.col(c).cast(kind).alias("_ts"), F.lit(sign).cast("long").alias("_s0"), *[(F.coalesce(F.col(x), F.lit(0)) * sign).alias(n) for x, n in zip(sums, names[1:])])
    total = lambda df, *by: df.groupBy(*key, *by).agg(*[F.sum(n).alias(n) for n in names])
    steps = total(side(start, 1).unionByName(side(end, -1)), "_ts").withColumn("_bucket", bucket_of("_ts", seconds, kind))
    p = points.select(*key, F.col(at).alias("_ts"), F.struct(*points.columns).alias("_p")).withColumn("_bucket", bucket_of("_ts", seconds, kind))
    asked = p.where("_bucket is not null").select(*key, "_bucket", F.lit(True).alias("_asked")).distinct()
    each = total(steps, "_bucket").unionByName(asked, allowMissingColumns=True).groupBy(*key, "_bucket").agg(*[F.sum(n).alias(n) for n in names], F.bool_or("_asked").alias("_asked"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*key, "_bucket", "_asked", *[F.sum(n).over(before).alias(n) for n in names]).where("_asked and _s0 is not null").drop("_asked")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_side", F.lit(2)), steps.withColumn("_side", F.lit(1)), carried.withColumn("_side", F.lit(0))])
    # A carried row has no time of its own: it comes first.
    w = Window.partitionBy(*key, "_bucket").orderBy(F.col("_ts").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key], F.col("_bucket").isNotNull())
    found = both.select("_p", "_side", *[F.when(known, F.sum(n).over(w)).alias(n) for n in names]).where("_side = 2")
    return found.select("_p.*", *[F.coalesce(F.col(n), F.lit(0)).alias(c) for n, c in zip(names, [count, *sums])])
