"""Connected components as joins: minimum labels over edges, with shortcuts through the labels themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratia.session import checkpoint

#: Rounds after which the loop gives up; shortcuts make paths of n nodes end in about log2(n) rounds.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", width: int | None = None) -> DataFrame:
    """(node, root) of each node that an edge names; root is the component's smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so that labels
    travel twice as far each time. Loops and repeated edges don't matter. Labels are one row a node; nothing is
    gathered, and a hub's edges meet in a partial minimum. width, where a caller knows how many rows to expect, bounds
    the partitions that a round writes, so that few edges don't make many small files.
    """
    held = lambda df: checkpoint(df if width is None else df.coalesce(width))
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = held(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct())
    labels = held(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")))
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        met = labels.join(seen, labels.node == seen.u).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        step = held(met.join(over, met.root == over.via).select("node", "old", F.least("root", "beyond").alias("root")))
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
