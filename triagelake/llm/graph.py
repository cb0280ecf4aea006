"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the edges (a, b); nulls and loops are left out.

    Contraction by rounds.  Each node points to whichever of its neighbours and itself comes first in an order by hash,
    and pointers are followed once more.  Edges move to where their ends point, equal ones merge and loops go.  In that
    order at most about half of the nodes of any chain are pointed to, and a star is gone in two rounds, so rounds grow
    with the logarithm of the longest chain, however the names ascend.  Every round's pointers are a checkpointed table
    over the nodes that are left, so neither a plan nor the sum of the tables grows with the rounds.  Answers run back
    through these tables, one join each.  A hub only ever reaches an aggregate with partial sums and a sort-merge join,
    which adaptive execution splits.
    """
    left = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds: list[DataFrame] = []
    place = lambda c: F.xxhash64(F.col(c))
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        first = both.groupBy("node").agg(F.min_by("other", place("other")).alias("other"))
        before = (place("other") < place("node")) | (place("other") == place("node")) & (F.col("other") < F.col("node"))
        hop = checkpoint(first.select("node", F.when(before, F.col("other")).otherwise(F.col("node")).alias("to")))
        far = hop.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hop = checkpoint(hop.join(far, "to").select("node", F.col("far").alias("to")))
        rounds.append(hop)
        a, b = (hop.select(F.col("node").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        moved = left.join(a, "a").join(b, "b").where("ta <> tb")
        left = checkpoint(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds.pop()
    for hop in reversed(rounds):  # where a round points to lives on in the next one, or was a component's last node
        later = out.select(F.col("node").alias("to"), F.col("to").alias("last"))
        out = checkpoint(hop.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")))
    least = out.groupBy("to").agg(F.min("node").alias("root"))
    return out.join(least, "to").select("node", "root")
