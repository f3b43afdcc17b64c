"""Connected components of a link table, by contraction in random orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link.

    Each round draws a new order of the nodes by a hash; every node goes to the first of itself and its neighbours, and
    links between the nodes that are left make the next, smaller table. The node that is first of its component takes
    all its neighbours in, so no round is idle and the loop ends when no link is left, whatever the ids; a third of the
    nodes go in a round on average, so rounds are logarithmic and their work sums up to a few times that of the first.
    Minima are combined per task before the shuffle; a node that many others go to is split by adaptive execution, as
    both sides of every join are read from staged tables. The driver only sees whether links are left.
    """
    links = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = stage(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    rounds = []
    while not rounds or not both.isEmpty():
        order = F.xxhash64("other", F.lit(len(rounds)))
        own = F.struct(F.xxhash64("node", F.lit(len(rounds))).alias("h"), F.col("node").alias("to"))
        near = both.groupBy("node").agg(F.min(F.struct(order.alias("h"), F.col("other").alias("to"))).alias("near"))
        moves = stage(near.select("node", F.least(own, F.col("near"))["to"].alias("to")), "moves")
        rounds.append(moves)
        ends = both.join(moves, "node").select("other", F.col("to").alias("x"))
        ends = ends.join(moves.select(F.col("node").alias("other"), F.col("to").alias("y")), "other").where("x <> y")
        both = stage(ends.select(F.col("x").alias("node"), F.col("y").alias("other")).distinct(), "links")
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = stage(rounds.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "moves")
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
