"""Formal concepts over bit masks of at most 62 attributes: closures, implications, missing cells, the lattice.

Objects are first counted by mask, so that the work follows distinct masks, not objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.session import checkpoint

#: Distinct masks up to which the lattice is built, and concepts after which it stops.
MOST_MASKS, MOST_CONCEPTS = 65_536, 100_000


def masks(objects: DataFrame, attributes: list[str]) -> DataFrame:
    """(mask, n): objects (tags) counted by their attributes' bits."""
    if len(attributes) > 62:
        raise ValueError("at most 62 attributes")
    bits = [F.when(F.array_contains("tags", a), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, a in enumerate(attributes)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return objects.select(total.alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def has(mask: Column, seed: Column) -> Column:
    return mask.bitwiseAND(seed) == seed


def closures(counted: DataFrame, seeds: list[int], attributes: int) -> DataFrame:
    """(seed, closure, support): what all objects with a seed's attributes share; all attributes, if there are none."""
    rows = counted.select("mask", "n", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))).alias("seed")).filter(has(F.col("mask"), F.col("seed")))
    found = rows.groupBy("seed").agg(F.bit_and("mask").alias("closure"), F.sum("n").alias("support"))
    every = counted.sparkSession.createDataFrame([(s,) for s in seeds], "seed long")
    return every.join(found, "seed", "left").select("seed", F.coalesce("closure", F.lit((1 << attributes) - 1)).alias("closure"), F.coalesce("support", F.lit(0)).alias("support"))


def implications(counted: DataFrame, attributes: int, least: int = 2) -> DataFrame:
    """(seed, consequent, support) of all seeds of one or two attributes that enough objects have."""
    single = [1 << i for i in range(attributes)]
    pairs = [a | b for i, a in enumerate(single) for b in single[i + 1 :]]
    found = closures(counted, single + pairs, attributes).withColumn("consequent", F.col("closure").bitwiseAND(F.bitwise_not("seed")))
    return found.filter((F.col("support") >= least) & (F.col("consequent") != 0)).select("seed", "consequent", "support")


def missing_cells(objects: DataFrame, least: float = 0.05) -> DataFrame:
    """(theory, tag, support, fraction): tags of enough objects that no object of a theory has; objects: (theory, tags)."""
    total = objects.agg(F.count("*").alias("total"))
    every = objects.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("support"))
    common = every.join(total).withColumn("fraction", F.col("support") / F.col("total")).filter(F.col("fraction") >= least)
    local = objects.select("theory", F.explode("tags").alias("tag")).distinct()
    theories = objects.select("theory").distinct()
    # Each theory meets the common tags, both tables of fixed kinds, and those it has go.
    grid = theories.join(common.agg(F.collect_list(F.struct("tag", "support", "fraction")).alias("tags"))).select("theory", F.explode("tags").alias("t")).select("theory", "t.*")
    return grid.join(local, ["theory", "tag"], "left_anti")


def lattice(counted: DataFrame, attributes: int, most: int = MOST_CONCEPTS) -> DataFrame:
    """(intent): all intents, by intersecting what is known with the objects' masks until nothing is new.

    Masks are few (checked); a lattice of more than `most` intents raises.
    """
    own = checkpoint(counted.select("mask").distinct())
    if own.count() > MOST_MASKS:
        raise ValueError(f"more than {MOST_MASKS} distinct masks")
    listed = own.agg(F.collect_list("mask").alias("masks"))
    known = checkpoint(counted.sparkSession.range(1).select(F.lit((1 << attributes) - 1).alias("intent")))
    fresh = known
    while not fresh.isEmpty():
        step = fresh.join(F.broadcast(listed)).select("intent", F.explode("masks").alias("m")).select(F.col("intent").bitwiseAND(F.col("m")).alias("intent")).distinct()
        fresh = checkpoint(step.join(known, "intent", "left_anti"))
        known = checkpoint(known.union(fresh))
        if known.count() > most:
            raise RuntimeError(f"more than {most} concepts")
    return known


def covers(intents: DataFrame) -> DataFrame:
    """(lower, upper): pairs of intents, the lower one a proper part of the upper, with none between.

    Of each intent and attribute beyond it, the least intent that has both is the intersection of those above that have the
    attribute, which meet by that attribute. Such an intent is a cover if each attribute that it adds leads to it.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(61))).alias("bit")
    at = lambda name: intents.select(F.col("intent").alias(name), bits)
    on = lambda name: F.expr(f"getbit({name}, bit)") == 1
    above = at("lower").filter(~on("lower")).join(at("upper").filter(on("upper")), "bit").filter(has(F.col("upper"), F.col("lower")))
    least = above.groupBy("lower", "bit").agg(F.bit_and("upper").alias("upper"))
    ways = least.groupBy("lower", "upper").agg(F.count("*").alias("n"))
    return ways.filter(F.col("n") == F.bit_count(F.col("upper").bitwiseAND(F.bitwise_not("lower")))).select("lower", "upper")
