"""Entity resolution: blocking, name similarity, components, survivorship."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import similarity
from tarnlake.operators.graph import connected_components


def _ratio(x: str, y: str) -> float:
    short, long = sorted((x, y), key=len)
    if len(long) < 200 and short in long:
        # The longest common block is the whole of the shorter name, so there is no other. Longer names have letters that the matcher passes over.
        return 2 * len(short) / (len(short) + len(long)) if long else 1.0
    return difflib.SequenceMatcher(None, x, y).ratio()


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _ratio(x.lower().strip(), y.lower().strip()) for x, y in zip(a, b)], dtype="float64")


def name_similarity(a, b):
    """Matching-block ratio of two names, lower-cased and trimmed; null where either is."""
    return F.pandas_udf(_similar, "double")(a, b)


#: A block of so many names at most is compared name by name.
SMALL = 16


def _near(left: DataFrame, right: DataFrame, block: list[str], threshold: float, same: bool) -> DataFrame:
    """(a, b, x, y) of the names of a block that may be similar: matching blocks match letters, so names that share too few letters never
    come to the measure. One and the same row is no pair; an empty name is similar to an empty one alone.

    Every name of ``left`` is in ``right``, too, so a small block has SMALL pairs for each of its names at most, and they
    are made as they are; only in larger ones are names met by their letters.
    """
    percent = int(threshold * 100)
    big = right.groupBy(*block).agg(F.count("*").alias("n_")).where(F.col("n_") > SMALL).select(*block)
    side = lambda df, i, n: df.select(*block, F.col("id").alias(i), F.col("name").alias(n))
    apart = F.expr("a < b") if same else F.expr("a <> b")
    low, high = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    few = side(left.join(big, block, "left_anti"), "a", "x").join(side(right, "b", "y"), block).where(apart & (low * (200 - percent) >= high * percent))

    l_big, r_big = (df.join(big, block, "left_semi") for df in (left, right))
    r, order = similarity.prepared(r_big, "id", block, similarity.letters(F.col("name")), percent, "dice")
    l_ = r if same else similarity.prepared(l_big, "id", block, similarity.letters(F.col("name")), percent, "dice", order)[0]
    found = similarity.candidates(l_, r, block, percent, "dice", same).where("a <> b").select("a", "b")
    names = lambda df, i, n: df.select(F.col("id").alias(i), F.col("name").alias(n))
    many = found.join(names(l_big, "a", "x"), "a").join(names(r_big, "b", "y"), "b").select("a", "b", "x", "y")
    empty = side(l_big.where("name = ''"), "a", "x").join(side(r_big.where("name = ''"), "b", "y"), block).where(apart)
    return few.select("a", "b", "x", "y").unionByName(many).unionByName(empty.select("a", "b", "x", "y"))


def candidate_links(people: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b) by two blocks: equal (ssn_last4, dob) with similar last names; and, for rows without an SSN, equal (dob, last name) with similar first names.

    Within a block, equal names meet only the least id that has them, so a hot block costs its distinct names and not
    the square of its rows.
    """
    p = people.select("id", "first_name", "last_name", "dob", "ssn_last4")
    low = lambda c: F.lower(F.trim(c))
    # Equal last names (or first names) are similar by definition: each joins the least id of its own.
    one = p.where("ssn_last4 is not null and last_name is not null").withColumn("name", low("last_name")).groupBy("ssn_last4", "dob", "name")
    same1 = one.agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).select("ssn_last4", "dob", "name", "a", F.explode("ids").alias("b"))
    reps1 = one.agg(F.min("id").alias("id")).where("dob is not null")
    near1 = _near(reps1, reps1, ["ssn_last4", "dob"], threshold, same=True)
    # The fallback links a row without an SSN to any row of its block, so one side is always such a row.
    two = p.where("last_name is not null and first_name is not null").withColumn("last", low("last_name")).withColumn("name", low("first_name"))
    bare = two.where("ssn_last4 is null").groupBy("dob", "last", "name").agg(F.min("id").alias("id"))
    same2 = two.where("ssn_last4 is null").alias("l").join(bare.alias("r"), ["dob", "last", "name"]).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    near2 = _near(bare.where("dob is not null"), two.where("dob is not null"), ["dob", "last"], threshold, same=False)
    near = near1.unionByName(near2).where(name_similarity("x", "y") >= threshold).select("a", "b")
    return same1.select("a", "b").unionByName(same2).unionByName(near).where("a <> b").distinct()


def resolve(people: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``people`` (with a bigint id) and the golden id of each: the least id of its component."""
    comp = connected_components(candidate_links(people, threshold)).withColumnRenamed("id", "_id")
    return people.join(comp, people.id == comp._id, "left").withColumn("golden_id", F.coalesce("component", "id")).drop("_id", "component")


def survive(resolved: DataFrame, columns: list[str], priority: dict[str, int], source: str = "source", tiebreak: str = "id") -> DataFrame:
    """One row for each golden id: every column from the best source that has it, lower sources only filling nulls."""
    rank = F.coalesce(F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])[F.col(source)], F.lit(999))
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(rank, F.col(tiebreak)))).alias(c)
    return resolved.groupBy("golden_id").agg(*[best(c) for c in columns], F.count("*").alias("records"))
