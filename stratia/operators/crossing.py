"""Two detectors of hypotheses that are too strong, and whether they agree: what proofs need, and what equal statements ask for.

Defined cases: rows without a class, or alone in one, are never flagged by the second detector; nulls in names match
nothing; with no eligible rows the control is a row of zeros and nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratia.functions.numbering import numbered
from stratia.operators.transfer import unit
from stratia.session import checkpoint, materialize

SEED = 20


def over_strong(verdicts: DataFrame) -> DataFrame:
    """(name): declarations of which a hypothesis is unused or stronger than its proof needs; verdicts as homes() gives them."""
    return verdicts.filter(F.col("verdict").isin("over-hypothesis", "unused") & ~F.col("projection")).select("name").distinct()


def stronger(members: DataFrame, asks: DataFrame, above: DataFrame) -> DataFrame:
    """(name, weaker): members of a class of equal statements that ask for more than another member does, and the first such set.

    members: (name, canon); asks: (name, class); above: (class, above), the strict ancestors. A set of classes is weaker
    than another, if it differs and each of its classes is in the other or above one of it. Distinct sets of a class are
    compared, not members, so that copies make no pairs; what a set reaches is spelled out once.
    """
    sets = asks.groupBy("name").agg(F.array_sort(F.collect_set("class")).alias("asks"))
    held = materialize(members.select("name", "canon").join(sets, "name"), "crossing")
    kinds = checkpoint(held.select("canon", "asks").distinct())
    one = kinds.select("asks").distinct().withColumn("class", F.explode("asks"))
    reach = one.select("asks", "class").union(one.join(above, "class").select("asks", F.col("above"))).distinct()
    each = kinds.withColumnRenamed("asks", "weak").withColumn("class", F.explode("weak"))
    met = kinds.join(reach, "asks").select("canon", "asks", "class").join(each, ["canon", "class"]).filter("asks <> weak")
    full = met.groupBy("canon", "asks", "weak").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("weak"))
    best = full.groupBy("canon", "asks").agg(F.min("weak").alias("weaker"))
    return held.join(best, ["canon", "asks"]).select("name", "weaker")


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, flagged): "both", "left" or "right", of names that a detector flags."""
    l, r = (x.select("name").distinct().withColumn(c, F.lit(True)) for x, c in ((left, "l"), (right, "r")))
    return l.join(r, "name", "full").select("name", F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("flagged"))


def control(left: DataFrame, right: DataFrame, eligible: DataFrame, seed: int = SEED) -> DataFrame:
    """(eligible, right, left, both, base, lifted, sham): does a flag of the left raise the odds of one of the right?

    All counts are over eligible rows, which both detectors could have flagged. base: the share of the right; lifted:
    its share among the left's; sham: how many distinct rows of the right as many draws by number hit as the left has.
    """
    pool = eligible.select("name").distinct()
    flags = crossed(left, right).join(pool, "name", "left_semi")
    counts = {r["flagged"]: r["count"] for r in flags.groupBy("flagged").count().collect()}  # three rows at most
    n, both = pool.count(), counts.get("both", 0)
    l, r = both + counts.get("left", 0), both + counts.get("right", 0)
    sham = 0
    if n and l:
        at = pool.sparkSession.range(l).select(F.pmod(unit(str(seed), F.col("id")), F.lit(n)).alias("i")).distinct()
        sham = numbered(pool, F.col("name")).join(at, "i").join(right.select("name").distinct(), "name", "left_semi").count()
    return pool.sparkSession.createDataFrame([(n, r, l, both, r / n if n else None, both / l if l else None, sham)], "eligible long, right long, left long, both long, base double, lifted double, sham long")
