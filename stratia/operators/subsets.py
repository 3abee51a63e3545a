"""Smallest sets of hypotheses that do, for all goals at once, level by level.

A level's sets are made from those of the level before that did not do: sets that share all but their last item are
joined, and a set stays only if all its subsets of that size were tried and failed, so that no superset of a hit is
ever tried. Sets are rows; no goal's sets are gathered.

Defined cases: a goal without items has the empty set alone to try; repeated items count once; null goals and items take
no part; a goal of which larger sets remain untried after `most` items is marked as cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratia.session import checkpoint

MOST_ITEMS = 4


def minimal_sets(goals: DataFrame, items: DataFrame, hits: Callable[[DataFrame], DataFrame], most: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(found, cut): found is (goal, items), the minimal sets that do; cut is (goal), those with larger sets left to try.

    goals: (goal); items: (goal, item); hits takes (goal, items) with sorted items and returns those that do. A set that
    does is taken to do with more items too.
    """
    items = checkpoint(items.filter("goal is not null and item is not null").select("goal", "item").distinct())
    tried = checkpoint(goals.filter("goal is not null").select("goal", F.array().cast(f"array<{items.schema['item'].dataType.simpleString()}>").alias("items")).distinct())
    found = None
    for size in range(most + 1):
        good = checkpoint(hits(tried).select("goal", "items"))
        found = good if found is None else found.union(good)
        failed = checkpoint(tried.join(good, ["goal", "items"], "left_anti").select("goal", "items"))
        if failed.isEmpty():
            return found, failed.select("goal")
        if size == 0:
            following = failed.select("goal").join(items, "goal").select("goal", F.array("item").alias("items"))
        else:
            split = failed.select("goal", F.slice("items", 1, size - 1).alias("front"), F.element_at("items", -1).alias("last"))
            pairs = split.join(split.withColumnRenamed("last", "next"), ["goal", "front"]).filter("last < next")
            made = pairs.select("goal", F.concat("front", F.array("last", "next")).alias("items"))
            parts = made.select("goal", "items", F.explode(F.sequence(F.lit(1), F.lit(size + 1))).alias("i")).select("goal", "items", F.filter("items", lambda x, k: k + 1 != F.col("i")).alias("part"))
            kept = parts.join(failed.withColumnRenamed("items", "part"), ["goal", "part"]).groupBy("goal", "items").agg(F.count("*").alias("n"))
            following = kept.filter(F.col("n") == size + 1).select("goal", "items")
        tried = checkpoint(following)
        if tried.isEmpty():
            return found, tried.select("goal")
    return found, tried.select("goal").distinct()


def covers(needs: DataFrame, upset: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A test for minimal_sets: sets of classes that have all that a goal needs at or above one of them.

    needs: (goal, need); upset: (class, at), each class with itself and what is above it.
    """
    needs = needs.select("goal", "need").distinct()
    total = checkpoint(needs.groupBy("goal").agg(F.count("*").alias("all")))

    def hits(sets: DataFrame) -> DataFrame:
        met = sets.select("goal", "items", F.explode("items").alias("class")).join(upset.select("class", F.col("at").alias("need")), "class").join(needs, ["goal", "need"])
        met = met.groupBy("goal", "items").agg(F.countDistinct("need").alias("met"))
        judged = sets.join(total, "goal", "left").join(met, ["goal", "items"], "left")
        return judged.filter(F.coalesce("met", F.lit(0)) == F.coalesce("all", F.lit(0)))

    return hits
