"""Choosing among the rows of a dictionary: every left side's best, a stable choice by proposals, or the best one by auction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratia.functions import assignment
from stratia.functions.components import connected_components
from stratia.session import checkpoint, materialize, shuffle_partitions

MOST_ROUNDS = 10_000


def select(scored: DataFrame, lefts: DataFrame, per_right: int | None = None) -> DataFrame:
    """(left, right, score, state, best) of each left side, from candidates (left, right, score), pairs distinct.

    Without a bound each left side takes its best (ties by right). With one, a right side takes at most per_right left sides:
    left sides propose in the order of their scores, and a right side keeps its best (ties by left) and turns the rest
    away, until no one is left to propose. The result is stable: no left and right side would both rather have one another. A
    round is a join and a window over proposals, so that no group of connected sides meets in one task; it drops every
    candidate that its right side would turn away, so that later rounds read the few that are left.

    States: selected; unmatched, with the best right side that was turned away; absent, for left sides without candidates.
    """
    order = Window.partitionBy("left").orderBy(F.col("score").desc(), "right")
    ranked = checkpoint(scored.filter("left is not null and right is not null and score is not null").select("left", "right", "score", F.row_number().over(order).alias("place")))
    best = ranked.filter("place = 1")
    held = best
    if per_right is not None:
        keeps = Window.partitionBy("right").orderBy(F.col("score").desc(), "left")
        rest = ranked  # candidates that no right side would turn away yet
        for _ in range(MOST_ROUNDS):
            held = materialize(rest.groupBy("left").agg(F.min(F.struct("place", "right", "score")).alias("b")).select("left", "b.right", "b.score", "b.place"), "proposals")
            asked = held.withColumn("r", F.row_number().over(keeps)).filter(F.col("r") <= per_right + 1)
            if asked.filter(F.col("r") > per_right).isEmpty():
                break
            last = asked.filter(F.col("r") == per_right).select("right", F.col("left").alias("l"), F.col("score").alias("s"))
            # A right side that has all it takes would turn away whatever comes after the last of them, now and later.
            stays = F.col("l").isNull() | (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("left") <= F.col("l")))
            rest = materialize(rest.join(last, "right", "left").filter(stays).select("left", "right", "score", "place"), "candidates")
        else:
            raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    out = lefts.select("left").distinct().join(held.drop("place"), "left", "left").join(best.select("left", F.col("right").alias("first")), "left", "left")
    state = F.when(F.col("right").isNotNull(), "selected").when(F.col("first").isNotNull(), "unmatched").otherwise("absent")
    return out.select("left", "right", "score", state.alias("state"), F.when(F.col("right").isNull(), F.col("first")).alias("best"))


#: Choices that one task holds; larger connected parts are dealt out by bidder.
MOST_CHOICES = 500_000
#: Scores count in units of 1 / SCALE.
SCALE = 10_000


def _choices(rows: DataFrame, per_right: int) -> DataFrame:
    """(part, bidder, object, real, s): the selection as a perfect assignment.

    Left sides bid for places of right sides or for themselves; places, mirrored, bid for mirrored left sides or for
    themselves. A side that stays alone on one half does so on the other, so that the best assignment is the best
    selection twice over, and everyone always has an object.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(per_right - 1)))
    slots = rows.withColumn("k", place).select("part", F.concat(F.lit("l"), "left").alias("l"), F.concat(F.lit("r"), F.col("k").cast("string"), F.lit(":"), "right").alias("r"), "s")
    yes, no = F.lit(True).alias("real"), F.lit(False).alias("real")
    none = F.lit(0).cast("long").alias("s")
    out = slots.select("part", F.col("l").alias("bidder"), F.col("r").alias("object"), yes, "s").union(slots.select("part", "r", "l", yes, "s"))
    return out.union(slots.select("part", "l", F.col("l"), no, none).distinct()).union(slots.select("part", "r", F.col("r"), no, none).distinct())


def _whole(pdf: pd.DataFrame, bidders: int | None = None, top: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Benefits in whole numbers: being selected counts more than all scores together, and all count in units of the bidders' number."""
    n = bidders if bidders is not None else pdf["bidder"].nunique()
    s = pdf["s"].to_numpy(np.int64)
    most = top if top is not None else int(np.abs(s).max(initial=0))
    if (2 * (n * most + 1)) * (n + 1) > assignment.LARGEST:
        raise OverflowError("a part has more sides and larger scores than 64 bits hold")
    return np.where(pdf["real"].to_numpy(bool), n * most + 1 + s, 0) * (n + 1), pdf["bidder"].to_numpy(), pdf["object"].to_numpy()


def _arrays(pdf: pd.DataFrame, bidders: int | None = None, top: int | None = None):
    pdf = pdf.sort_values(["bidder", "object"], kind="stable")
    benefit, bidder, object_ = _whole(pdf, bidders, top)
    names, first = np.unique(bidder, return_index=True)
    objects, at = np.unique(object_, return_inverse=True)
    return names, np.append(first, len(pdf)), objects, at, benefit, pdf


HELD = "part string, bidder string, object string, price long"


def _solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """(part, bidder, object, price) of one part, checked against its own prices."""
    names, start, objects, at, benefit, pdf = _arrays(pdf)
    held, price = assignment.solve(start, at, benefit, len(objects))
    if assignment.gap(start, at, benefit, held, price) > len(names):
        raise RuntimeError("prices do not show that the selection is best")
    return pd.DataFrame({"part": pdf["part"].iloc[0], "bidder": names, "object": objects[held], "price": price[held]})


def _bids(eps: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, start, objects, at, benefit, rows = _arrays(pdf, int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0]))
        price = rows.groupby("object")["price"].first().reindex(objects).to_numpy(np.int64)
        got = assignment.bid(start, at, benefit, price, eps)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "bidder": names, "object": objects[got], "price": price[got]})

    return run


def _auctioned(choices: DataFrame) -> DataFrame:
    """(part, bidder, object, price) of parts that no task holds.

    For each eps all bidders start without an object. In a round those without one bring their choices with the prices to
    their block, where they bid against each other from those prices; an object then takes the highest of its new bids
    if that is over its price, and who held it joins the next round. Prices only rise, so bids at older prices stay
    within eps of the best.
    """
    choices = materialize(choices, "choices")
    sizes = checkpoint(choices.groupBy("part").agg(F.countDistinct("bidder").alias("n"), F.max(F.abs("s")).alias("most"), F.count("*").alias("choices")))
    largest = sizes.agg(F.max((2 * (F.col("n").cast("double") * F.col("most") + 1)) * (F.col("n") + 1)).alias("b"), F.max("choices").alias("c")).first()
    eps, blocks = max(1, int(largest["b"]) // 4), -(-largest["c"] // MOST_CHOICES)
    prices = checkpoint(choices.select("part", "object").distinct().withColumn("price", F.lit(0).cast("long")))
    everyone = choices.select("part", "bidder").distinct()
    while True:
        held, free = None, everyone
        for _ in range(MOST_ROUNDS):
            asked = choices.join(free, ["part", "bidder"]).join(prices, ["part", "object"]).join(F.broadcast(sizes.select("part", "n", "most")), "part")
            block = F.pmod(F.xxhash64("bidder"), F.lit(blocks)).alias("block")
            bids = checkpoint(asked.select("*", block).groupBy("part", "block").applyInPandas(_bids(eps), HELD))
            best = bids.groupBy("part", "object").agg(F.max(F.struct("price", "bidder")).alias("b")).select("part", "object", F.col("b.bidder").alias("new"), F.col("b.price").alias("bid"))
            before = prices.join(held.select("part", "object", "bidder"), ["part", "object"], "left") if held is not None else prices.withColumn("bidder", F.lit(None).cast("string"))
            merged = checkpoint(before.join(best, ["part", "object"], "left"))
            won = F.col("bid").isNotNull() & (F.col("bid") > F.col("price"))
            prices = merged.select("part", "object", F.when(won, F.col("bid")).otherwise(F.col("price")).alias("price"))
            held = merged.select("part", "object", F.when(won, F.col("new")).otherwise(F.col("bidder")).alias("bidder"), F.when(won, F.col("bid")).otherwise(F.col("price")).alias("price")).filter("bidder is not null")
            free = checkpoint(everyone.join(held.select("part", "bidder"), ["part", "bidder"], "left_anti"))
            if free.isEmpty():
                break
        else:
            raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
        if eps == 1:
            return held.select("part", "bidder", "object", "price")
        eps = max(1, eps // assignment.FALL)


def _contenders(fine: DataFrame, per_right: int) -> DataFrame:
    """(part, left, right, s): the connected parts of fine (left, right, s), without rows that a best selection can do without.

    Parts are told apart by right sides alone: a left side links its first right side to its others. A right side can do
    with as many of its best rows (ties by left) as its part has places: were it to take another, one of those would be
    free, as all other places together hold fewer, and would do as well. So a part of few right sides stays small
    however many left sides want them.
    """
    firsts = fine.groupBy("left").agg(F.min("right").alias("a"))
    parts = connected_components(fine.join(firsts, "left").select("a", F.col("right").alias("b")).distinct())
    parts = parts.select(F.col("node").alias("right"), F.col("root").alias("part"))
    places = checkpoint(parts.join(parts.groupBy("part").agg((F.count("*") * per_right).alias("places")), "part"))
    most = places.agg(F.max("places")).first()[0] or 0
    order = Window.partitionBy("right").orderBy(F.col("s").desc(), "left")
    near = fine.select("left", "right", "s").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return near.join(places, "right").filter(F.col("place") <= F.col("places")).select("part", "left", "right", "s")


def best_selection(scored: DataFrame, lefts: DataFrame, per_right: int = 1, floor: float | None = None, refuted: DataFrame | None = None, unsupported: DataFrame | None = None) -> DataFrame:
    """(left, right, score, state, best) of each left side: the most rows that right sides can bear, then the best total score.

    Each right side takes at most per_right left sides. States: selected; unmatched (best: the right side of the best
    candidate); low-ranked, where all candidates score below the floor (best: that candidate); contradicted, where all that
    remain are refuted pairs (left, right); unsupported, for the left sides named so without a row; absent, without candidates.

    Connected parts are told apart first, and a right side keeps as many rows as its part has places. One of up to MOST_CHOICES choices is an auction inside a task, any number of them
    side by side; a larger one is dealt out to blocks of bidders, which exchange prices. Final prices show that no other
    selection is better, which is checked for each part. Scores count in units of 1 / SCALE, cut off.
    """
    rows = scored.filter("left is not null and right is not null and score is not null").groupBy("left", "right").agg(F.max("score").alias("score"))
    fine = rows if floor is None else rows.filter(F.col("score") >= floor)
    fine = fine if refuted is None else fine.join(refuted.select("left", "right").distinct(), ["left", "right"], "left_anti")
    fine = materialize(fine.withColumn("s", (F.col("score") * SCALE).cast("long")), "selection")
    choices = materialize(_choices(_contenders(fine, per_right), per_right), "choices")
    sizes = checkpoint(choices.groupBy("part").agg(F.count("*").alias("n")))
    small = choices.join(sizes.filter(F.col("n") <= MOST_CHOICES).select("part"), "part", "left_semi")
    # Dealt out by number: parts are few bytes and much work.
    found = small.repartition(shuffle_partitions(scored.sparkSession), "part").groupBy("part").applyInPandas(_solved, HELD)
    large = sizes.filter(F.col("n") > MOST_CHOICES).select("part")
    if not large.isEmpty():
        many = materialize(choices.join(large, "part", "left_semi"), "choices")
        held = materialize(_auctioned(many), "auction")
        _certified(many, held)
        found = found.union(held)
    picked = found.filter("bidder like 'l%' and object like 'r%'").select(F.expr("substr(bidder, 2)").alias("left"), F.regexp_replace("object", r"^r\d+:", "").alias("right"))
    picked = materialize(picked, "selected")
    kept = fine.select("left", "right", "score").join(picked, ["left", "right"])
    top = lambda df, as_: df.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("down"), "right")).alias("t")).select("left", F.col("t.right").alias(as_))
    out = lefts.select("left").distinct().join(kept, "left", "left").join(top(fine, "first"), "left", "left").join(top(rows, "any"), "left", "left")
    low = rows.filter(F.col("score") >= floor) if floor is not None else rows
    out = out.join(low.select("left").distinct().withColumn("over", F.lit(True)), "left", "left")
    out = out.join((unsupported if unsupported is not None else lefts.limit(0)).select("left").distinct().withColumn("off", F.lit(True)), "left", "left")
    state = F.when(F.col("right").isNotNull(), "selected").when(F.col("first").isNotNull(), "unmatched").when(F.col("over"), "contradicted").when(F.col("any").isNotNull(), "low-ranked").when(F.col("off"), "unsupported").otherwise("absent")
    return out.select("left", "right", "score", state.alias("state"), F.when(F.col("right").isNull(), F.coalesce("first", "any")).alias("best"))


def _certified(choices: DataFrame, held: DataFrame) -> None:
    """Raise unless prices show that what is held is best: no bidder has a choice that is better by more than one."""
    sizes = choices.groupBy("part").agg(F.countDistinct("bidder").alias("n"), F.max(F.abs("s")).alias("most"))
    worth = F.when(F.col("real"), F.col("n") * F.col("most") + 1 + F.col("s")).otherwise(F.lit(0)) * (F.col("n") + 1)
    valued = choices.join(F.broadcast(sizes), "part").join(held.select("part", "object", "price", F.col("bidder").alias("owner")), ["part", "object"]).withColumn("value", worth - F.col("price"))
    found = valued.groupBy("part", "bidder").agg(F.max("value").alias("best"), F.max(F.when(F.col("owner") == F.col("bidder"), F.col("value"))).alias("own"))
    if not found.filter("own is null or best > own + 1").isEmpty():
        raise RuntimeError("prices do not show that the selection is best")
