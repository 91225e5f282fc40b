"""Semi-structured text as VARIANT: typed paths with checks, and hot paths as columns of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, name: str = "v") -> DataFrame:
    """The table with its text parsed into ``name``; null where the text is null or no JSON, with ``<name>_bad`` true for the latter."""
    v = F.try_parse_json(F.col(text))
    return df.withColumn(name, v).withColumn(f"{name}_bad", F.col(text).isNotNull() & v.isNull())


def value(column: str, path: str, kind: str) -> Column:
    """A path as a type; null where it is missing, null, or does not convert."""
    return F.try_variant_get(F.col(column), path, kind)


def present(column: str, path: str) -> Column:
    """Whether a path holds anything but null."""
    held = F.try_variant_get(F.col(column), path, "variant")
    return held.isNotNull() & ~F.coalesce(F.is_variant_null(held), F.lit(True))


def kind_of(column: str, path: str) -> Column:
    """The type that a path holds, as Spark names it; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.col(column), path, "variant"))


def typed(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """The table with a column for each name: (path, type), and ``_mistyped``: the names whose path holds something that is not of its type."""
    cols = {n: value(column, path, kind) for n, (path, kind) in paths.items()}
    off = [F.when(present(column, path) & value(column, path, kind).isNull(), F.lit(n)) for n, (path, kind) in paths.items()]
    return df.select("*", *[c.alias(n) for n, c in cols.items()], F.array_compact(F.array(*off)).alias("_mistyped"))


def shred(df: DataFrame, column: str, hot: dict[str, str]) -> DataFrame:
    """Hot fields of an object (name: type) as columns, and the object without them as ``<column>_rest``.

    A field that does not convert to its type stays in the rest, so nothing is lost; what is no object stays there whole.
    """
    out = typed(df, column, {n: (f"$.{n}", kind) for n, kind in hot.items()})
    fields = F.expr(f"try_cast({column} as map<string, variant>)")
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*hot) | F.array_contains("_mistyped", k))
    whole = F.expr(f"substring(schema_of_variant({column}), 1, 6)") == "OBJECT"
    return out.withColumn(f"{column}_rest", F.when(whole, F.to_variant_object(rest)).otherwise(F.col(column))).drop(column, "_mistyped")

