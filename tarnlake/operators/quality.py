"""Data-quality checks: declared rules, compiled so that a table is scanned once for all its single-table checks."""

from __future__ import annotations

import html
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.operators.quantiles import exact_quantiles

RESULTS = "run_id string, table_name string, check_name string, severity string, status string, failed_count long, total_count long, detail string, checked_at timestamp"


@dataclass
class Check:
    """kind: completeness, uniqueness, non_negative, accepted, rule, outliers, relationship, row_count, balance or freshness.

    ``tolerance`` is a fraction of rows (or of the control value) that may fail.
    """

    table: str
    name: str
    kind: str
    column: str | None = None
    columns: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)
    condition: str | None = None
    parent: str | None = None
    parent_column: str | None = None
    control: float | None = None
    tolerance: float = 0.0
    severity: str = "FAIL"
    null_fk_is_orphan: bool = False
    as_of: str | None = None
    days: int | None = None


def load_checks(text: str) -> list[Check]:
    import yaml

    return [Check(**c) for c in (yaml.safe_load(text) or {}).get("checks", [])]


def failing(check: Check) -> Column | None:
    """The rows that fail a row check; null results of a condition pass."""
    c = F.col(check.column) if check.column else None
    if check.kind == "completeness":
        return c.isNull()
    if check.kind == "non_negative":
        return F.coalesce(c < 0, F.lit(False)) & (F.expr(check.condition) if check.condition else F.lit(True))
    if check.kind == "accepted":
        return c.isNotNull() & ~c.isin(*check.values)
    if check.kind == "rule" and check.condition:
        return F.coalesce(~F.expr(check.condition), F.lit(False))
    return None


def single_pass(df: DataFrame, checks: list[Check]) -> dict[str, tuple[int, int, str]]:
    """(failed, total, detail) of every check that looks at the table alone: all in one aggregate, but uniqueness, which counts its own
    key's groups with no other column read."""
    aggs, names = [F.count("*").alias("_n")], []
    for i, c in enumerate(checks):
        bad = failing(c)
        if bad is not None:
            aggs.append(F.count_if(bad).alias(f"c{i}"))
        elif c.kind == "balance":
            aggs.append(F.sum(F.col(c.column).cast("decimal(38,2)")).alias(f"c{i}"))
        elif c.kind == "freshness":
            aggs.append(F.datediff(F.lit(c.as_of).cast("date"), F.max(F.to_date(c.column))).alias(f"c{i}"))
        elif c.kind == "row_count" and not c.parent:
            aggs.append(F.count("*").alias(f"c{i}"))
        elif c.kind != "uniqueness":
            continue
        names.append((i, c))
    row = df.agg(*aggs).first()
    total, out = int(row["_n"]), {ALL: (0, int(row["_n"]), "")}
    for i, c in names:
        if c.kind == "uniqueness":
            out[c.name] = (repeats(df, c.columns, c.condition), total, "")
        elif c.kind == "balance":
            value = row[f"c{i}"] or 0
            out[c.name] = (int(abs(float(value) - c.control) > c.tolerance * abs(c.control)), 1, f"{value} against {c.control}")
        elif c.kind == "freshness":
            age = row[f"c{i}"]
            out[c.name] = (int(age is None or age > c.days), 1, f"{age} days")
        elif c.kind == "row_count":
            out[c.name] = _rows_against(total, int(c.control), c.tolerance)
        else:
            out[c.name] = (int(row[f"c{i}"] or 0), total, "")
    return out


def repeats(df: DataFrame, columns: list[str], condition: str | None = None) -> int:
    """How many rows repeat a key that another row has; nulls are equal. A hot key is counted by all tasks before it is shuffled."""
    keyed = (df.where(condition) if condition else df).groupBy(*columns).agg(F.count("*").alias("_rows"))
    return int(keyed.agg(F.sum(F.col("_rows") - 1)).first()[0] or 0)


def _rows_against(a: int, b: int, tolerance: float) -> tuple[int, int, str]:
    return 0 if abs(a - b) <= tolerance * max(b, 1) else max(1, abs(a - b)), b, f"{a} against {b}"


#: The entry of a single pass that holds the number of rows.
ALL = ""


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, null_is_orphan: bool = False) -> DataFrame:
    rows = child if null_is_orphan else child.where(F.col(column).isNotNull())
    return rows.join(parent.select(F.col(parent_column).alias("_p")).distinct(), F.col(column) == F.col("_p"), "left_anti")


#: Rows up to which the engine's exact percentile, which holds all distinct values in one task, is the shorter way.
ONE_TASK = 1_000_000


def outlier_bounds(df: DataFrame, column: str, approximate: bool = False, factor: float = 3.0, rows: int | None = None) -> tuple[float, float]:
    """Quartiles widened by ``factor`` of their distance; exact ones of a large table by selection over all tasks."""
    if approximate or (df.count() if rows is None else rows) <= ONE_TASK:
        f = (lambda q: F.percentile_approx(column, q, 10_000)) if approximate else (lambda q: F.percentile(F.col(column), q))
        q1, q3 = df.agg(f(F.lit(0.25)), f(F.lit(0.75))).first()
    else:
        found = {r.p: r.value for r in exact_quantiles(df, [], column, [0.25, 0.75]).collect()}
        q1, q3 = found.get(0.25), found.get(0.75)
    return (float("-inf"), float("inf")) if q1 is None else (float(q1) - factor * (float(q3) - float(q1)), float(q3) + factor * (float(q3) - float(q1)))


def run_checks(tables: dict[str, DataFrame], checks: list[Check], spark: SparkSession) -> DataFrame:
    """One result row for each check. Absent tables and rules without a condition are SKIPPED; errors count -1."""
    run, now, out = uuid.uuid4().hex, datetime.now(timezone.utc), []
    by_table: dict[str, list[Check]] = {}
    for c in checks:
        by_table.setdefault(c.table, []).append(c)
    for name, own in by_table.items():
        df = tables.get(name)
        if df is None:
            out += [(run, name, c.name, c.severity, "SKIPPED", 0, 0, "no such table", now) for c in own]
            continue
        try:
            done = single_pass(df, own)
        except PySparkException:
            done = {}
            for c in own:  # one bad rule must not hide the others
                try:
                    done |= single_pass(df, [c])
                except PySparkException as e:
                    done[c.name] = (-1, -1, "")
                    c.detail_error = str(e).split("\n")[0][:200]
        for c in own:
            detail = getattr(c, "detail_error", "")
            if c.name in done:
                failed, total, told = done[c.name]
                detail = detail or told
            elif c.kind == "rule":
                out.append((run, name, c.name, c.severity, "SKIPPED", 0, 0, "no condition", now))
                continue
            else:
                try:
                    rows = done[ALL][1] if ALL in done else df.count()
                    failed, total, detail = _special(df, c, tables, rows)
                except (PySparkException, KeyError) as e:
                    failed, total, detail = -1, -1, str(e).split("\n")[0][:200]
            bad = failed < 0 or failed > c.tolerance * max(total, 1) if c.severity != "INFO" else failed < 0
            out.append((run, name, c.name, c.severity, "FAILED" if bad else "PASSED", failed, total, detail, now))
    return spark.createDataFrame(out, RESULTS)


def _special(df: DataFrame, c: Check, tables: dict[str, DataFrame], total: int) -> tuple[int, int, str]:
    if c.kind == "relationship":
        return orphans(df, c.column, tables[c.parent], c.parent_column, c.null_fk_is_orphan).count(), total, ""
    if c.kind == "row_count":
        return _rows_against(total, tables[c.parent].count(), c.tolerance)
    if c.kind == "outliers":
        lo, hi = outlier_bounds(df, c.column, rows=total)
        return df.where((F.col(c.column) < lo) | (F.col(c.column) > hi)).count(), total, f"[{lo}, {hi}]"
    raise KeyError(f"unknown kind {c.kind}")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("severity", "status").agg(F.count("*").alias("checks"))


def gate(results: DataFrame) -> bool:
    """Whether no check of severity FAIL failed."""
    return results.where("severity = 'FAIL' and status = 'FAILED'").isEmpty()


def latest_run(results: DataFrame) -> DataFrame:
    run = results.agg(F.max_by("run_id", "checked_at")).first()[0]
    return results.where(F.col("run_id") == run)


def dashboard_rows(results: DataFrame) -> DataFrame:
    """The latest run with each check's ``place`` on the dashboard: failures first, then what was skipped. A run has one row for each check."""
    order = F.when(F.col("status") == "FAILED", 0).when(F.col("status") == "SKIPPED", 1).otherwise(2)
    return latest_run(results).withColumn("place", F.row_number().over(Window.orderBy(order, "severity", "table_name", "check_name")))


def dashboard(results: DataFrame) -> str:
    """The latest run as an HTML table."""
    rows = dashboard_rows(results).orderBy("place").collect()
    cells = "".join("<tr class='%s'>%s</tr>" % (r.status.lower(), "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in ("table_name", "check_name", "severity", "status", "failed_count", "total_count", "detail"))) for r in rows)
    return f"<!doctype html><title>Data quality</title><table><tr><th>table<th>check<th>severity<th>status<th>failed<th>total<th>detail</tr>{cells}</table>"


def load_schema_tests(text: str) -> list[Check]:
    """Checks from a model file in YAML: models with columns whose tests are not_null, unique, accepted_values and relationships.

    A test is a name, or a name with its arguments; ``severity: warn`` makes it a WARN. A model's own tests may name several columns that are unique together.
    """
    import yaml

    out = []
    for model in (yaml.safe_load(text) or {}).get("models", []):
        columns = [*model.get("columns", []), *([{"name": None, "tests": model["tests"]}] if "tests" in model else [])]
        for c in columns:
            for test in c.get("tests", []):
                kind, args = (test, {}) if isinstance(test, str) else next(iter(test.items()))
                name, table, column = f"{kind}_{c['name'] or '_'.join(args.get('columns', []))}", model["name"], c["name"]
                severity = "WARN" if args.get("severity", "error") == "warn" else "FAIL"
                if kind == "not_null":
                    out.append(Check(table, name, "completeness", column, severity=severity))
                elif kind == "unique":
                    out.append(Check(table, name, "uniqueness", columns=[column], condition=f"`{column}` is not null", severity=severity))
                elif kind == "unique_combination":
                    out.append(Check(table, name, "uniqueness", columns=args["columns"], severity=severity))
                elif kind == "accepted_values":
                    out.append(Check(table, name, "accepted", column, values=args["values"], severity=severity))
                elif kind == "relationships":
                    out.append(Check(table, name, "relationship", column, parent=args["to"], parent_column=args["field"], severity=severity))
                else:
                    raise ValueError(f"{table}: unknown test {kind}")
    return out


def achieved_rates(df: DataFrame, rates: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(name, achieved, wanted, tolerance, ok): the share of rows that each condition holds for, against what was wanted; one pass.

    An empty table achieves nothing: null and not ok.
    """
    row = df.agg(*[F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"r{i}") for i, (c, _, _) in enumerate(rates.values())])
    each = [F.struct(F.lit(n).alias("name"), F.col(f"r{i}").alias("achieved"), F.lit(float(w)).alias("wanted"), F.lit(float(t)).alias("tolerance")) for i, (n, (_, w, t)) in enumerate(rates.items())]
    ok = F.coalesce(F.abs(F.col("achieved") - F.col("wanted")) <= F.col("tolerance"), F.lit(False))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*").withColumn("ok", ok)


def health(tables: dict[str, DataFrame], scd2: dict[str, str], keys: list[tuple[str, str, str, str]], spark: SparkSession, results: DataFrame | None = None) -> DataFrame:
    """Row counts, keys with several open versions, orphan keys, and the failed checks of the last run of ``results``: (item, value, healthy)."""
    out = [(f"rows:{n}", df.count(), True) for n, df in tables.items()]
    out = [(i, v, v > 0) for i, v, _ in out]
    for n, key in scd2.items():
        v = tables[n].where("is_current").groupBy(key).count().where("count > 1").count()
        out.append((f"open_versions:{n}", v, v == 0))
    for child, column, parent, parent_column in keys:
        v = orphans(tables[child], column, tables[parent], parent_column).count()
        out.append((f"orphans:{child}.{column}", v, v == 0))
    if results is not None:
        v = latest_run(results).where("status = 'FAILED' and severity = 'FAIL'").count()
        out.append(("last_run:failed", v, v == 0))
    return spark.createDataFrame(out, "item string, value long, healthy boolean")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    # One row beside each value.
    all_ = df.agg(F.count("*").alias("all_"))
    return g.crossJoin(F.broadcast(all_)).select(column, "n", (F.col("n") / F.col("all_")).alias("share"))


def append_results(results: DataFrame, path: str) -> None:
    """Add a run to the table of results, by day of the run."""
    results.withColumn("checked_on", F.to_date("checked_at")).write.mode("append").partitionBy("checked_on").parquet(path)


def join_loss(child: DataFrame, column: str, parent: DataFrame, parent_column: str, most: float = 0.03, by: str | None = None) -> DataFrame:
    """One row: rows, those that an inner join would lose, their share, and whether that is at most ``most``. Null keys are lost too.

    ``by`` names a column of the child for whose values there is a row each, from the same join; in the row of all it is null.
    """
    keys = parent.select(F.col(parent_column).alias("_p")).distinct().withColumn("_in", F.lit(True))
    j = child.select(F.col(column).alias("_c"), *([by] if by else [])).join(keys, F.col("_c") == F.col("_p"), "left")
    aggs = [F.count("*").alias("total"), F.count_if(F.col("_in").isNull()).alias("lost")]
    g = j.rollup(by).agg(*aggs) if by else j.agg(*aggs)
    share = F.coalesce(F.col("lost") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return g.select(*([by] if by else []), "total", "lost", share.alias("share"), (share <= most).alias("passed"))
