"""Connected components by distributed hooking and contraction, in DataFrame operations only.

Each round hooks every node to its smallest neighbour, halves the paths, and contracts the edges; a graph of long chains
takes a logarithmic number of rounds. Nothing is gathered in one place: minima are pre-aggregated before the shuffle, and
each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that the edges reach) for every node of `edges` (a, b; any order, loops allowed)."""
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p"))
        hook = staged(hook, "cc-hook")
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("q"))
        jump = staged(hook.join(up, "p").select("x", "q"), "cc-jump")
        to = lambda side: jump.select(F.col("x").alias(side), F.col("q").alias(f"{side}2"))  # noqa: B023, E731
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        tails = jump.select(F.col("q").alias("p")).distinct().join(up, "p").select(F.col("p").alias("a"), F.col("q").alias("b"))
        moved = moved.union(tails).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        following = staged(moved, "cc-edges")
        if labels is None:
            labels, table = jump.select(F.col("x").alias("node"), F.col("q").alias("component")), jump
            spent = [left, hook]
        else:
            step = jump.select(F.col("x").alias("component"), "q")
            labels = staged(labels.join(step, "component", "left").select("node", F.coalesce("q", "component").alias("component")), "cc-labels")
            spent, table = [left, hook, jump, table], labels
        dropped(*spent)
        left = following
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
