"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) undirected edges -> (id, component), component being the smallest id reachable.

    Nodes without an edge are not listed; null ends and self loops are ignored; repeated edges are
    harmless. Each round takes the minimum label over the neighbours and then jumps to that label's
    own label, so long chains halve. Every round is written to the shared folder, and it stops at
    the first round that changes nothing. Hot nodes only meet partial aggregates and joins.
    """
    # Read in both directions, made once.
    e = materialize(edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null and a <> b"), "pairs")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"))
    labels = materialize(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("nid")).agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.nid).select("id", F.least("component", "near").alias("hop"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("hop"), F.col("component").alias("jump"))
        new = step.join(jump, "hop", "left").select("id", F.least("hop", F.coalesce("jump", "hop")).alias("component"), "old")
        new = materialize(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
