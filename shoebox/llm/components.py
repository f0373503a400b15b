"""Connected components over an edge table, by contraction.

Each round maps every vertex to the least vertex of its closed
neighbourhood, follows that map one step further, and rewrites the edges
by it; edges inside one class vanish.  Rounds stop when none is left.
Rounds are cut by tables in the shared folder.  Hot vertices only meet
in aggregates with partial sums and in joins of two written tables,
which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """a, b -> vertex, component: the least vertex that is reachable; vertices without an edge to another are left out.

    Null ends, loops and repeated edges are allowed and don't link anything.
    """
    edges = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-e0")
    labels = None
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")).select("v", F.least("v", "to").alias("to"))
        least = scratch.put(least, f"{label}-m{k}a")
        step = least.select(F.col("v").alias("to"), F.col("to").alias("next"))
        least = scratch.put(least.join(step, "to").select("v", F.col("next").alias("to")), f"{label}-m{k}")
        if labels is None:
            labels = least.select("v", "to")
        else:
            labels = labels.join(least.select(F.col("v").alias("to"), F.col("to").alias("next")), "to", "left").select("v", F.coalesce("next", "to").alias("to"))
        labels = scratch.put(labels, f"{label}-l{k}")
        to_a, to_b = (least.select(F.col("v").alias(x), F.col("to").alias(f"m{x}")) for x in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").where("ma <> mb").select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct()
        edges = scratch.put(moved, f"{label}-e{k}")
        scratch.drop(f"{label}-e{k - 1}", f"{label}-m{k}a", f"{label}-m{k}", *([f"{label}-l{k - 1}"] if k > 1 else []))
    if labels is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels.select(F.col("v").alias("vertex"), F.col("to").alias("component"))
