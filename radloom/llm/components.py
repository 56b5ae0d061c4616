"""Connected components of an edge table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest node reachable.

    Alternates large-star and small-star steps: each moves the edges of a node
    to the smallest node near it, so a path of n nodes needs about log(n)
    rounds.  A hot node costs one partial aggregate and a join on its own key.
    Each round is written to the shared folder.  Null ends are dropped; with
    no edge the result is empty.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = scratch.put(pairs, "edges")
    state = _state(pairs)
    for _ in range(rounds):
        if not state[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m <> a").select("a", F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mins.select("a", F.col("m").alias("b")))
        after = scratch.put(small.where("a <> b").distinct(), "edges")
        new = _state(after)
        scratch.drop(pairs)
        pairs, same, state = after, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them: equal when a round changed nothing."""
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(pmod(xxhash64(b, a), 1000003) as bigint))")).first())
