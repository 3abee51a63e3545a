"""Replacements of names as a dictionary: does what one half of the theories shows hold in the other, and do rewritten statements exist?

Each distinct statement is one row, under its first name; replacements come from pairs of those that differ by one. What is
drawn at random comes from hashes of a seed and a number, so that reruns agree.

Defined cases: a name that no statement has is never drawn; a replacement by itself changes nothing and does not count; no
pairs give inventories of nothing and rates of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.functions.numbering import running
from stratia.operators import statements as st
from stratia.session import checkpoint, materialize

SEED, TRIALS, LEAST = 11, 8, (1, 2, 3)
#: Ranges of equal width that the drawn positions meet names in.
RANGES = 4096


def distinct_statements(parsed: DataFrame) -> DataFrame:
    """parsed with one row for each statement, the first by name."""
    first = parsed.groupBy("root").agg(F.min("name").alias("name"))
    return parsed.join(first, ["root", "name"]).dropDuplicates(["root"])


def unit(*parts: Column | str) -> Column:
    """A number below 2^60 from a hash of the parts."""
    joined = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def pairs(reps: DataFrame) -> DataFrame:
    """(name, other, a, b, rigid): distinct statements that differ by one replacement of a by b, each pair both ways."""
    found = st.variants(reps, 1)
    edit = F.get("edits", F.lit(0))
    return found.select("name", "other", edit["s"].alias("a"), edit["t"].alias("b")).join(reps.select("name", "rigid"), "name")


def occurrences(parsed: DataFrame) -> DataFrame:
    """(sym, start, n): how often each symbol stands in all statements, and the sum of those before it by name.

    Occurrences are counted first; the sum runs over ranges of symbols.
    """
    counted = parsed.select(F.explode("symbols").alias("sym")).groupBy("sym").agg(F.count("*").alias("n"))
    return checkpoint(running(counted, "n", "sym", column="start").select("sym", F.col("start").cast("long").alias("start"), "n"))


def redrawn(keys: DataFrame, seen: DataFrame, seed: int, *by: str) -> DataFrame:
    """keys with `drawn`: a symbol as often as statements have it, by a hash of the seed and the columns `by`.

    Positions and symbols meet by ranges of positions of one width, of which a symbol covers as many as it needs.
    """
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return keys.withColumn("drawn", F.lit(None).cast("string")).limit(0)
    width = max(1, -(-total // RANGES))
    placed = keys.withColumn("at", F.pmod(unit(str(seed), *map(F.col, by)), F.lit(total)))
    spread = seen.select(F.col("sym").alias("drawn"), "start", (F.col("start") + F.col("n")).alias("end"))
    spread = spread.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    met = placed.withColumn("range", F.floor(F.col("at") / width)).join(spread, "range").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return met.drop("at", "range", "start", "end")


def _unordered(found: DataFrame) -> DataFrame:
    return found.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))


def transfer(parsed: DataFrame, theories: DataFrame, seed: int = SEED, trials: int = TRIALS) -> DataFrame:
    """(least, inventory, held, hits, held_pairs, hit_pairs, null_mean, null_most): replacements learned on half of the theories.

    theories: (name, theory). A theory's half is a bit of its hash. A replacement is learned if at least `least` rigid
    skeletons of the first half show it; held are those of the second half. The null keeps a held replacement's first
    name and draws the other as often as statements have it.
    """
    reps = materialize(distinct_statements(parsed), "transfer")
    side = theories.select("name", (unit(str(seed), F.col("theory")) % 2).alias("half"))
    found = pairs(reps).filter("name < other").join(side, "name").join(side.select(F.col("name").alias("other"), F.col("half").alias("half2")), "other").filter("half = half2")
    found = materialize(_unordered(found), "transfer")
    learned = found.filter("half = 0").groupBy("lo", "hi").agg(F.countDistinct("rigid").alias("skeletons"))
    learned = checkpoint(learned)
    held = checkpoint(found.filter("half = 1").groupBy("lo", "hi").agg(F.count("*").alias("n")))
    drawn = redrawn(held.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")), occurrences(reps), seed, "trial", "lo", "hi")
    null = drawn.select("trial", F.least("lo", "drawn").alias("lo"), F.greatest("lo", "drawn").alias("hi")).join(learned, ["lo", "hi"])
    real = held.join(learned, ["lo", "hi"])
    counts = lambda df, *keys: df.groupBy(*keys).agg(*(F.count_if(F.col("skeletons") >= k).alias(f"c{k}") for k in LEAST), *(F.coalesce(F.sum(F.when(F.col("skeletons") >= k, F.col("n"))), F.lit(0)).alias(f"p{k}") for k in LEAST if "n" in df.columns))
    size, hit = counts(learned).first(), counts(real).first()
    all_held = held.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    by_trial = {r["trial"]: r for r in counts(null, "trial").collect()}  # a row a trial
    rows = []
    for k in LEAST:
        nulls = [by_trial[t][f"c{k}"] if t in by_trial else 0 for t in range(trials)]
        rows.append((k, size[f"c{k}"], all_held["c"], hit[f"c{k}"], all_held["n"], hit[f"p{k}"], sum(nulls) / trials, max(nulls)))
    return parsed.sparkSession.createDataFrame(rows, "least int, inventory long, held long, hits long, held_pairs long, hit_pairs long, null_mean double, null_most long")


def rewritten(reps: DataFrame, directed: DataFrame) -> DataFrame:
    """(name, a, b, image): each statement with each of its names a replaced by b, and the first name that states the result, if any.

    directed: (a, b), distinct. A statement is its rigid skeleton and its names in order, so that the image is looked up by
    an equi-join on both, without writing it out.
    """
    has = reps.select("name", "rigid", "slots", F.explode(F.array_distinct("slots")).alias("a"))
    made = has.join(directed.filter("a <> b"), "a").withColumn("slots", F.transform("slots", lambda s: F.when(s == F.col("a"), F.col("b")).otherwise(s)))
    known = reps.groupBy("rigid", "slots").agg(F.min("name").alias("image"))
    return made.join(known, ["rigid", "slots"], "left").select("name", "a", "b", "image")


def inventory(reps: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, skeletons): replacements, both ways, that at least so many rigid skeletons show."""
    return pairs(reps).groupBy("a", "b").agg(F.countDistinct("rigid").alias("skeletons")).filter(F.col("skeletons") >= least)


def transports(parsed: DataFrame, least: int = 2, seed: int = SEED) -> DataFrame:
    """(arm, tried, hits, open): rewriting by the inventory, and by one whose second names are drawn.

    The control has one direction of each replacement, from its first name to a drawn one.
    """
    reps = materialize(distinct_statements(parsed), "transports")
    known = checkpoint(inventory(reps, least))
    control = redrawn(known.filter("a < b").select("a", "b"), occurrences(reps), seed, "a", "b").select("a", F.col("drawn").alias("b")).distinct()
    out = None
    for arm, directed in (("inventory", known.select("a", "b")), ("control", control)):
        # The image is another statement, as the names differ.
        one = rewritten(reps, directed).agg(F.count("*").alias("tried"), F.count("image").alias("hits"), F.count_if(F.col("image").isNull()).alias("open")).select(F.lit(arm).alias("arm"), "tried", "hits", "open")
        out = one if out is None else out.union(one)
    return out


def open_targets(parsed: DataFrame, least: int = 2) -> DataFrame:
    """(name, a, b, image) of all rewrites by the inventory; those without an image are targets that nobody has stated."""
    reps = materialize(distinct_statements(parsed), "transports")
    return rewritten(reps, checkpoint(inventory(reps, least)).select("a", "b"))
