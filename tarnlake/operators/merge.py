"""Row-level changes as pure functions: (state, changes) -> new state.

Plain Parquet has no MERGE, so each function returns the whole new table as a DataFrame; persist it
with ``tarnlake.operators.tables``, which swaps versions. Every function shuffles on the business key once or
twice, and running one again with the same changes gives the same table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import materialize

END_OF_TIME = "9999-12-31 00:00:00"


def end_of_time() -> Column:
    return F.lit(END_OF_TIME).cast("timestamp_ntz")


def changed(columns: list[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe: any of the columns differs."""
    return reduce(lambda a, b: a | b, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``, which must be total for a repeatable result."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(state: DataFrame, changes: DataFrame, key: list[str], update: list[str] | None = None) -> DataFrame:
    """Insert new keys, and take the ``update`` columns (all by default) of known ones. ``changes`` has a key once."""
    update = update if update is not None else [c for c in state.columns if c not in key]
    s, c = state.withColumn("_s", F.lit(True)), changes.withColumn("_c", F.lit(True))
    on = reduce(lambda a, b: a & b, [s[k].eqNullSafe(c[k]) for k in key])
    j = s.alias("s").join(c.alias("c"), on, "full_outer")
    out = []
    for name in state.columns:
        new, old = F.col(f"c.{name}") if name in changes.columns else F.lit(None), F.col(f"s.{name}")
        take = F.col("c._c") & (F.col("s._s").isNull() | F.lit(name in update))
        out.append(F.when(take, new).otherwise(old).alias(name))
    return j.select(*out)


def insert_only(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Add the rows of unknown keys; known rows never change."""
    return state.unionByName(changes.join(state.select(*key), key, "left_anti").select(*state.columns), allowMissingColumns=True)


def scd2_history(log: DataFrame, key: list[str], ts: str, compare: list[str], tiebreak: list[str] | None = None, every_row: bool = False) -> DataFrame:
    """Versions from a full change log in one window pass: effective_start, effective_end (half open), is_current.

    A row opens a version if a tracked column differs, null-safe, from the row before it in time; ``every_row`` makes
    each row a version. Rows with equal time and key count in ``tiebreak`` order, and the last one stands.
    """
    tie = [F.col(c) for c in tiebreak or []]
    w = Window.partitionBy(*key).orderBy(F.col(ts), *tie)
    # Of rows with one time the last holds; the others would be versions of no length.
    final = log.withColumn("_next", F.lead(ts).over(w)).where(F.col("_next").isNull() | (F.col("_next") != F.col(ts))).drop("_next")
    now = F.struct(*compare)
    before = F.lag(now).over(w)
    kept = final if every_row else final.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")
    end = F.coalesce(F.lead(ts).over(w), end_of_time().cast(dict(log.dtypes)[ts]))
    out = kept.withColumn("effective_end", end).withColumn("effective_start", F.col(ts))
    return out.withColumn("is_current", F.col("effective_end") == end_of_time().cast(dict(log.dtypes)[ts]))


def scd2_apply(state: DataFrame, changes: DataFrame, key: list[str], ts: str, compare: list[str], tiebreak: list[str] | None = None) -> DataFrame:
    """Apply a batch to versions kept by ``scd2_history``: closed versions stay, open ones take part in the new order.

    Unchanged records that are sent again open nothing; several changes of a key in one batch each become a
    version; a batch that was applied before changes nothing. Late rows, older than the open version, are left out.
    """
    columns = [c for c in state.columns if c not in ("effective_start", "effective_end", "is_current")]
    kind = dict(state.dtypes)[ts]
    held = state.withColumn(ts, F.col("effective_start")).select(*columns, "effective_end", (~F.col("is_current")).alias("_closed"), F.lit(False).alias("_new"))
    fresh = changes.select(*columns, F.lit(None).cast(dict(state.dtypes)["effective_end"]).alias("effective_end"), F.lit(False).alias("_closed"), F.lit(True).alias("_new"))
    # One union, and one shuffle on the key that serves every window below.
    rows = held.unionByName(fresh)
    rows = rows.withColumn("_open", F.max(F.when(~F.col("_closed") & ~F.col("_new"), F.col(ts))).over(Window.partitionBy(*key)))
    rows = rows.where(~F.col("_new") | F.col("_open").isNull() | (F.col(ts) > F.col("_open")))
    w = Window.partitionBy(*key, "_closed").orderBy(F.col(ts), *[F.col(c) for c in tiebreak or []])
    last = rows.withColumn("_next", F.lead(ts).over(w)).where(F.col("_closed") | F.col("_next").isNull() | (F.col("_next") != F.col(ts)))
    now = F.struct(*compare)
    kept = last.withColumn("_before", F.lag(now).over(w)).where(F.col("_closed") | F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now))
    end = F.when(F.col("_closed"), F.col("effective_end")).otherwise(F.coalesce(F.lead(ts).over(w), end_of_time().cast(kind)))
    out = kept.withColumn("effective_end", end).withColumn("effective_start", F.col(ts))
    return out.withColumn("is_current", ~F.col("_closed") & (F.col("effective_end") == end_of_time().cast(kind))).select(*state.columns)


def scd2_two_pass(state: DataFrame, changes: DataFrame, key: list[str], ts: str, compare: list[str]) -> DataFrame:
    """The literal two passes: close changed open rows, then insert every source row whose time is not an open start.

    Kept to compare with recorded baselines: a record sent again unchanged makes a second open row.
    """
    types = dict(state.dtypes)
    s, c = state.alias("l"), latest(changes, key, [F.col(ts).desc()]).alias("r")
    hit = c.withColumn("_hit", F.lit(True)).alias("r")
    j = s.join(hit, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left")
    close = F.col("l.is_current") & F.coalesce(F.col("r._hit"), F.lit(False)) & changed(compare)
    passed = j.select(*[(F.when(close, F.col(f"r.{ts}")).otherwise(F.col("l.effective_end")) if n == "effective_end" else F.when(close, F.lit(False)).otherwise(F.col("l.is_current")) if n == "is_current" else F.col(f"l.{n}")).alias(n) for n in state.columns])
    opened = passed.where("is_current").select(*key, F.col("effective_start").alias(ts))
    new = changes.join(opened, [*key, ts], "left_anti").withColumn("effective_start", F.col(ts)).withColumn("effective_end", end_of_time().cast(types["effective_end"])).withColumn("is_current", F.lit(True))
    return passed.unionByName(new.select(*state.columns))


def scd2_events(entities: DataFrame, events: DataFrame, key: str, start: str, ts: str, flags: dict[str, Column], firsts: dict[str, Column] | None = None) -> DataFrame:
    """Versions at each event time, with flags that once true stay true, by running windows and no self join.

    ``flags`` name conditions on event rows; ``firsts`` name conditions of which the first time is kept.
    """
    firsts = firsts or {}
    points = entities.select(key, F.col(start).alias(ts)).unionByName(events.select(key, ts, *[c.alias(n) for n, c in flags.items()], *[F.when(c, F.col(ts)).alias(n) for n, c in firsts.items()]), allowMissingColumns=True)
    each = points.groupBy(key, ts).agg(*[F.bool_or(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in flags], *[F.min(n).alias(n) for n in firsts])
    w = Window.partitionBy(key).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = each.select(key, F.col(ts).alias("effective_start"), *[F.bool_or(n).over(run).alias(n) for n in flags], *[F.min(n).over(run).alias(n) for n in firsts], F.lead(ts).over(w).alias("_next"))
    kind = dict(events.dtypes)[ts]
    return out.withColumn("effective_end", F.coalesce("_next", end_of_time().cast(kind))).withColumn("is_current", F.col("_next").isNull()).drop("_next")


def snapshot_check(state: DataFrame | None, current: DataFrame, key: list[str], columns: list[str], now: Column) -> DataFrame:
    """A check-strategy snapshot: rows with valid_from and valid_to (null while they hold)."""
    fresh = current.withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    if state is None:
        return fresh
    live = state.where("valid_to is null").alias("l")
    j = live.join(current.withColumn("_in", F.lit(True)).alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left")
    moved = F.coalesce(F.col("r._in"), F.lit(False)) & changed(columns)
    held = j.select(*[(F.when(moved, now).otherwise(F.col("l.valid_to")) if c == "valid_to" else F.col(f"l.{c}")).alias(c) for c in state.columns])
    same = held.where("valid_to is null").select(*key)
    return state.where("valid_to is not null").unionByName(held).unionByName(fresh.join(same, key, "left_anti").select(*state.columns))


def reconcile_deletes(state: DataFrame, full: DataFrame, key: list[str]) -> DataFrame:
    """``is_deleted`` for keys that a full snapshot no longer has."""
    seen = full.select(*key).distinct().withColumn("_seen", F.lit(True))
    return state.join(seen, key, "left").withColumn("is_deleted", F.col("_seen").isNull()).drop("_seen").select(*state.columns, *([] if "is_deleted" in state.columns else ["is_deleted"]))


def current_as_of(log: DataFrame, key: list[str], ts: str, cutoff: Column, tiebreak: list[str] | None = None) -> DataFrame:
    """The rows that held at a cutoff: the latest of each key at or before it."""
    return latest(log.where(F.col(ts) <= cutoff), key, [F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak or []]])


def hash_key(*columns: str, name: str = "sk") -> Column:
    """A surrogate key that does not depend on order or partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])).alias(name)


def sequence_key(df: DataFrame, order: list[str], start: int = 0, name: str = "sk") -> DataFrame:
    """Dense bigint keys in ``order``: rows are numbered within range partitions, and partitions by their totals."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    held = materialize(parts, "sequence")
    totals = held.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = totals.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.join(F.broadcast(before), "_part").withColumn(name, (rank + F.col("_before") + start).cast("bigint")).drop("_part", "_before")
