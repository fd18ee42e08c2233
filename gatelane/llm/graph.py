"""Connected components by randomised contraction.

Each round every node picks, among itself and its neighbours, the one whose hash is
smallest; edges are rewritten to the picked nodes and loops drop out. The hash changes
every round, so the number of nodes shrinks by a constant factor in expectation,
whatever the shape (long chains included). Only partial aggregates and joins are used:
a node with very many edges is combined before the shuffle, and adaptive execution
splits it in the joins. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, component being the smallest node reachable.

    Nodes without an edge to another node do not appear. Rows with a null end,
    loops and repeated edges are allowed and change nothing.
    """
    pairs = edges.filter((F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    current = written(pairs, "edges-0")
    picks, turn = [], 0
    while not is_empty(current):
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        sides = current.select("a", rank("b").alias("r")).unionByName(
            current.select(F.col("b").alias("a"), rank("a").alias("r"))
        )
        best = sides.groupBy("a").agg(F.min("r").alias("r"))
        pick = written(best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("r"))["n"].alias("to")), f"pick-{turn}")
        picks.append(pick)
        left = pick.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = pick.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = current.join(left, "a").join(right, "b").filter(F.col("ta") != F.col("tb"))
        current = written(
            moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"edges-{turn}"
        )
    if not picks:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = picks[0]
    for pick in picks[1:]:
        step = pick.select(F.col("node").alias("to"), F.col("to").alias("next"))
        placed = placed.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    placed = written(placed, "placed")
    lowest = placed.groupBy("to").agg(F.min("node").alias("component"))
    return placed.join(lowest, "to").select("node", "component")
