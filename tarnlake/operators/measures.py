"""Named measures over a star: composed columns, filter context, time shifts, automatic joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import ratio


@dataclass
class Model:
    """Facts, dimensions and many-to-one relationships: (fact, column) -> (dimension, column)."""

    tables: dict[str, DataFrame]
    links: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    measures: dict[str, tuple[str, Callable[[Column], Column]]] = field(default_factory=dict)
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)

    def measure(self, name: str, fact: str, make: Callable[[Column], Column]) -> None:
        """``make`` gets the filter context as a condition and returns the aggregate under it."""
        self.measures[name] = (fact, make)

    def divide(self, name: str, over: str, under: str) -> None:
        """A ratio of two measures; null where the lower one is 0."""
        self.ratios[name] = (over, under)

    def wide(self, fact: str) -> DataFrame:
        """A fact with the columns of all that it reaches over many-to-one links: dimensions, theirs, and another fact."""
        df = self.tables[fact]
        for (f, column), (dim, key) in self.links.items():
            if f == fact:
                d = self.wide(dim)
                keep = [c for c in d.columns if c == key or c not in df.columns]
                d = d.select(*[F.col(c).alias(f"_k_{dim}") if c == key else F.col(c) for c in keep])
                df = df.join(d, F.col(column) == F.col(f"_k_{dim}"), "left")
        return df

    def evaluate(self, names: list[str], by: list[str], where: dict[str, Column] | None = None) -> DataFrame:
        """The measures by some dimension columns; ``where`` overrides the filter context of single measures."""
        where = where or {}
        base = [m for n in names for m in (self.ratios[n] if n in self.ratios else (n,))]
        facts: dict[str, list[str]] = {}
        for m in dict.fromkeys(base):
            facts.setdefault(self.measures[m][0], []).append(m)
        out = None
        for fact, own in facts.items():
            g = self.wide(fact).groupBy(*by).agg(*[self.measures[m][1](where.get(m, F.lit(True))).alias(m) for m in own])
            out = g if out is None else out.join(g, by, "full_outer") if by else out.crossJoin(g)
        return out.select(*by, *[(ratio(F.col(self.ratios[n][0]), F.col(self.ratios[n][1])) if n in self.ratios else F.col(n)).alias(n) for n in names])


def calendar_rollup(df: DataFrame, day: str, aggregates: list[Column]) -> DataFrame:
    """Totals by year, quarter, month and day, and of all."""
    d = df.withColumn("year", F.year(day)).withColumn("quarter", F.quarter(day)).withColumn("month", F.month(day)).withColumn("day", F.dayofmonth(day))
    return d.rollup("year", "quarter", "month", "day").agg(*aggregates)
