"""Pairs of similar names within blocks, at the cost of what is near and not of all pairs.

A name is a set of tokens. Two sets that share enough must share one of the first few tokens of each, whatever order the tokens are
in (the prefix filter); with the rarest tokens first these meet seldom. Sizes that cannot agree are left out in the join, the places of
the first common token bound what a pair may share, and the candidates that remain are counted exactly, once each, in native columns.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.session import materialize


def clean(name: Column | str) -> Column:
    return F.lower(F.trim(name))


def grams(name: Column, q: int = 3) -> Column:
    """The distinct stretches of ``q`` letters of a name with blanks at both ends; an empty or null name has none."""
    padded = F.concat(F.lit(" " * (q - 1)), name, F.lit(" " * (q - 1)))
    # Held in an array of one, the padded name is made once and not for each stretch.
    cut = F.flatten(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - q + 1), lambda i: F.substring(p, i, F.lit(q)))))
    return F.when(F.length(name) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def letters(name: Column) -> Column:
    """The letters of a name, each with how often it came before: what two names share of these bounds every matching of their letters."""
    chars = F.split(name, "")
    # The i-th letter's number among its like.
    each = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.when(F.length(name) > 0, each).otherwise(F.array().cast("array<string>"))


def _least(n: Column, percent: int, measure: str) -> Column:
    """How many tokens a set of ``n`` shares at least with any similar one."""
    of = 100 if measure == "jaccard" else 200 - percent
    return F.floor((n * percent + (of - 1)) / of)


def prepared(df: DataFrame, id_col: str, block: list[str], tokens: Column, percent: int, measure: str, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sets: id, block columns, tokens from the rarest on, size; how often each token is found).

    ``order`` gives the counts of tokens where other sets are to be ordered alike; tokens that it lacks are the rarest.
    """
    rows = df.select(F.col(id_col).alias("id"), *block, tokens.alias("tokens")).where(F.size("tokens") > 0)
    each = rows.select("id", *block, F.explode("tokens").alias("t"))
    order = each.groupBy("t").agg(F.count("*").alias("df")) if order is None else order
    ranked = each.join(order, "t", "left").groupBy("id", *block).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("s"))
    return ranked.select("id", *block, F.col("s.t").alias("tokens"), F.size("s").alias("size")), order


def candidates(left: DataFrame, right: DataFrame, block: list[str], percent: int, measure: str = "jaccard", same: bool = False) -> DataFrame:
    """(a, b) with both sets, of pairs that may be similar: every similar pair, each once. ``same``: a row's pairs with itself and with lesser ids are left out."""
    def side(df: DataFrame, s: str) -> DataFrame:
        keep = (F.col("size") - _least(F.col("size"), percent, measure) + 1).cast("int")
        return df.select("id", *block, "size", F.posexplode(F.slice("tokens", F.lit(1), keep)).alias("at", "t")).select(*block, "t", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "at")])

    sizes = [F.col("size_l"), F.col("size_r")]
    low, high = F.least(*sizes), F.greatest(*sizes)
    fits = (low * 100 >= high * percent) if measure == "jaccard" else (low * (200 - percent) >= high * percent)
    # A side has many rows for each set, which Spark doesn't foresee: it would broadcast them all through the driver.
    j = side(left, "l").join(side(right, "r").hint("merge"), [*block, "t"]).where(fits)
    j = j.where("id_l < id_r") if same else j
    pairs = j.groupBy("id_l", "id_r", *block).agg(F.first("size_l").alias("size_l"), F.first("size_r").alias("size_r"), F.min("at_l").alias("at_l"), F.min("at_r").alias("at_r"))
    # Nothing before the first common token is shared.
    most = F.least(F.col("size_l") - F.col("at_l"), F.col("size_r") - F.col("at_r"))
    return pairs.where(_similar(most, percent, measure)).select(*block, F.col("id_l").alias("a"), F.col("id_r").alias("b"))


#: Signatures of a set for one size of its partner at most, and tokens of a signature at most.
SIGNATURES, DEPTH = 64, 5
#: For each number of tokens that the larger set of a pair may miss of the other: how many tokens a signature has, so that SIGNATURES do. Beyond: one.
_DEPTHS = [n[-1] for gone in range(SIGNATURES) if (n := [d for d in range(2, DEPTH + 1) if math.comb(d + gone, d) <= SIGNATURES])]
#: A signature of two tokens or more has them among so many first ones.
_REACH = max(gone + d for gone, d in enumerate(_DEPTHS))


def _shapes(sets: DataFrame, percent: int) -> DataFrame:
    """(size, larger, d, leave): which signatures sets of a size need as the smaller or the larger one of a pair: of d tokens among the first leave + d."""
    n, m, share = F.col("size"), F.col("other"), F.col("share")
    sizes = F.sequence(F.ceil(n * percent / 100 - 1e-9).cast("int"), F.floor(n * 100 / percent + 1e-9).cast("int"))
    each = sets.select("size").distinct().select("size", F.explode(sizes).alias("other"))
    each = each.withColumn("share", F.floor(((n + m) * percent + (99 + percent)) / (100 + percent)).cast("int")).where((share <= n) & (share <= m))
    depth = F.coalesce(F.get(F.array(*map(F.lit, _DEPTHS)), F.greatest(n, m) - share), F.lit(1))
    sides = F.when(n < m, F.array(F.lit(False))).when(n > m, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    return each.select("size", F.explode(sides).alias("larger"), F.least(share, depth).alias("d"), (n - share).alias("leave")).groupBy("size", "larger", "d").agg(F.max("leave").alias("leave"))


def close_candidates(sets: DataFrame, block: list[str], percent: int) -> DataFrame:
    """(a, b) with a < b of the pairs of ``candidates`` with Jaccard and ``same``, for blocks whose tokens are few and common.

    One shared token says little where there are a thousand tokens and a million sets. Two sets of n and m tokens that share o at least agree in d tokens
    of their first n - o + d and m - o + d (all orders alike): so they have a signature of d tokens in common. d is as large as SIGNATURES allows for
    the sizes of a pair; a set makes its signatures once for all partners' sizes with one d, and sets of many tokens fall back to one token. A
    signature is one number, so a pair may rarely have no tokens or not even the block in common.
    """
    spark = sets.sparkSession
    # These grow with the sizes that sets have, not with the sets.
    shapes = _shapes(sets, percent)
    masks = spark.range(1, 1 << _REACH).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("d"))
    parts = shapes.where("d > 1").join(F.broadcast(masks), "d").where("mask < shiftleft(1, leave + d)").select("size", "larger", "d", "mask")
    token = lambda i: F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.get("tokens", F.lit(i)))
    some = sets.join(F.broadcast(parts), "size").select("id", "size", "larger", F.xxhash64(*block, "d", *map(token, range(_REACH))).alias("h"))
    one = sets.join(F.broadcast(shapes.where("d = 1")), "size").select("id", "size", "larger", *block, F.explode(F.slice("tokens", F.lit(1), F.col("leave") + 1)).alias("t"))
    made = some.unionByName(one.select("id", "size", "larger", F.xxhash64(*block, F.lit(1), "t").alias("h")))
    left = made.where("not larger").select("h", F.col("id").alias("_x"), F.col("size").alias("s"))
    right = made.where("larger").select("h", F.col("id").alias("_y"), F.col("size").alias("o"))
    # A set has many signatures, which Spark doesn't foresee: it would broadcast them all through the driver.
    found = left.join(right.hint("merge"), "h").where(f"s * 100 >= o * {percent} and (s < o or s = o and _x < _y)")
    return found.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def _similar(shared: Column, percent: int, measure: str, a: str = "size_l", b: str = "size_r") -> Column:
    both = F.col(a) + F.col(b)
    return (shared * 100 >= (both - shared) * percent) if measure == "jaccard" else (shared * 200 >= both * percent)


def similar_pairs(df: DataFrame, id_col: str, tokens: Column, percent: int, block: list[str] | None = None, measure: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """(pairs of classes: block columns, a, b, shared, size_a, size_b; members: id, class).

    Rows of one block with equal sets are one class, named by its least id, so copies cost no pairs: each row's class is in the second
    table, and every pair of classes whose sets are similar by ``percent`` is in the first with a < b. Jaccard counts the shared part of
    the union, Dice twice the shared part of both sizes. Rows without tokens or with a null in a block column are similar to nothing. Ids are unique.
    """
    block = block or []
    one = F.lit(0).alias("_all")
    rows = df.select(F.col(id_col).alias("id"), *(block or [one]), F.array_sort(tokens).alias("_tokens"))
    by = block or ["_all"]
    known = rows.where(F.size("_tokens") > 0)
    classes = known.groupBy(*by, "_tokens").agg(F.min("id").alias("class"))
    members = rows.join(classes, [*by, "_tokens"], "left").select("id", F.coalesce("class", "id").alias("class"))
    whole = functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by])
    sets = materialize(prepared(classes.where(whole), "class", by, F.col("_tokens"), percent, measure)[0], "similar-sets")
    found = close_candidates(sets, by, percent) if measure == "jaccard" else candidates(sets, sets, by, percent, measure, same=True)
    get = lambda names, own: sets.select(*[F.col(c).alias(n) for c, n in zip(("id", "tokens", "size", *by), (*names, *own))]).hint("merge")
    other = [f"{c}_b" for c in by]
    j = found.select("a", "b").join(get(("a", "x", "size_a"), by), "a").join(get(("b", "y", "size_b"), other), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    pairs = j.where(functools.reduce(lambda x, y: x & y, [F.col(c) == F.col(o) for c, o in zip(by, other)]) & _similar(F.col("shared"), percent, measure, "size_a", "size_b"))
    return pairs.select(*block, "a", "b", "shared", "size_a", "size_b"), members
