"""Methods for declarations: tags from symbols, scores of a catalogue, diversity, Pareto fronts, traces, benchmarks.

A catalogue is a Python list of methods (a few dozen), each a dict with method, family, recognizes, native, unlocks. It goes into
plans as one literal array, so that scoring explodes it beside each object and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratia.session import checkpoint

# Fixed values of the scoring.
BASE, DISTANCE, BRIDGE, NOVELTY, BREADTH = 0.44, 0.18, 0.16, 0.10, 0.12
FITS, FAMILY_PENALTY = 0.34, 0.68
OUTCOMES = {"succeeded": 1.10, "failed": 0.55, "refuted": 0.20, "blocked": 0.70, "inconclusive": 0.90}
OBJECTIVES = ("compatibility", "distance", "bridge", "novelty", "gain", "experience")
STRENGTHS = {"compatibility": "compatibility", "distance": "domain-distance", "bridge": "bridge-value", "novelty": "novelty-of-view", "gain": "representation-breadth"}


def classify(declarations: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, tag, evidence): tags whose needle a lower-cased symbol contains, with those symbols.

    declarations: (name, symbols); rules: (tag, needle), a table of fixed size that is broadcast.
    """
    rows = declarations.select("name", F.explode(F.array_distinct("symbols")).alias("sym"))
    hit = rows.join(F.broadcast(rules), F.lower("sym").contains(F.col("needle")))
    return hit.groupBy("name", "tag").agg(F.sort_array(F.collect_set("sym")).alias("evidence"))


def catalogue(methods: list[dict]) -> Column:
    """The catalogue as a literal array of structs, in its order."""
    listed = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m["method"]).alias("method"), F.lit(m["family"]).alias("family"), *(listed(m[k]).alias(k) for k in ("recognizes", "native", "unlocks"))) for i, m in enumerate(methods)))


def part_present(wanted: Column, tags: Column) -> Column:
    """The share of `wanted` that is among the tags; 0 of none."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, tags)) / F.size(wanted))


def breadth(methods: Column, tags: Column) -> Column:
    """How many methods fit the tags well enough."""
    return F.size(F.filter(methods, lambda m: part_present(m["recognizes"], tags) >= FITS))


def candidates(objects: DataFrame, methods: list[dict], experience: DataFrame | None = None) -> DataFrame:
    """Scores of each method that fits an object at all. objects: (name, tags); experience: (name, method, experience)."""
    every, tags = catalogue(methods), F.col("tags")
    rows = objects.select("name", "tags", breadth(every, tags).alias("before"), F.explode(every).alias("m"))
    rows = rows.withColumn("compatibility", part_present(F.col("m.recognizes"), tags)).filter("compatibility > 0")
    seen = part_present(F.col("m.unlocks"), tags)
    rows = rows.select(
        "name", "tags", F.col("m.i").alias("i"), F.col("m.method").alias("method"), F.col("m.family").alias("family"), "compatibility",
        (1 - part_present(F.col("m.native"), tags)).alias("distance"), F.when(F.size("m.unlocks") == 0, 0.0).otherwise(1 - seen).alias("bridge"),
        F.when(F.size("m.unlocks") == 0, 0.5).otherwise(1 - seen).alias("novelty"),
        F.greatest(breadth(every, F.array_union(tags, F.col("m.unlocks"))) - F.col("before"), F.lit(0)).alias("gain"),
    )
    if experience is not None:
        rows = rows.join(experience.select("name", "method", "experience"), ["name", "method"], "left")
    factor = F.coalesce(F.col("experience"), F.lit(1.0)) if experience is not None else F.lit(1.0)
    rows = rows.withColumn("experience", factor)
    fit = BASE + DISTANCE * F.col("distance") + BRIDGE * F.col("bridge") + NOVELTY * F.col("novelty") + BREADTH * F.least(F.col("gain") / 5, F.lit(1.0))
    return rows.withColumn("base", F.col("compatibility") * fit * F.col("experience"))


def diversify(scored: DataFrame, top: int = 10) -> DataFrame:
    """The `top` of each object after a penalty for methods of a family that is already there.

    The greedy choice multiplies a score by the penalty once for each earlier pick of the family. A family's scores
    only fall, so the k-th best of a family is penalised k - 1 times, and two windows give the greedy order.
    """
    family = Window.partitionBy("name", "family").orderBy(F.round("base", 12).desc(), "i")
    out = scored.withColumn("score", F.col("base") * F.pow(F.lit(FAMILY_PENALTY), F.row_number().over(family) - 1))
    order = Window.partitionBy("name").orderBy(F.round("score", 12).desc(), "i")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _below(axis: str):
    return lambda o: o[axis] < F.col(f"me.{axis}")


def pareto(scored: DataFrame) -> DataFrame:
    """The methods of each object that no other dominates, with the axes on which each beats some other.

    An object's methods are at most the catalogue, so they meet as one array.
    """
    each = F.struct("method", "base", *OBJECTIVES)
    rows = scored.withColumn("all", F.collect_list(F.struct(*OBJECTIVES)).over(Window.partitionBy("name"))).withColumn("me", each)
    ge = lambda o: [o[k] >= F.col(f"me.{k}") for k in OBJECTIVES]
    gt = lambda o: [o[k] > F.col(f"me.{k}") for k in OBJECTIVES]

    def dominates(o: Column) -> Column:
        every, some = ge(o)[0], gt(o)[0]
        for x, y in zip(ge(o)[1:], gt(o)[1:], strict=True):
            every, some = every & x, some | y
        return every & some

    beats = F.array_compact(F.array(*(F.when(F.exists("all", _below(k)), F.lit(label)) for k, label in STRENGTHS.items())))
    return rows.filter(~F.exists("all", dominates)).select("name", "method", "base", beats.alias("strengths"))


def experience_factor(attempts: DataFrame) -> DataFrame:
    """(name, method, experience): the product of the outcomes' factors over (problem, method, outcome)."""
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair)), F.col("outcome"))
    # A product as counts of five outcomes: partial sums instead of lists.
    counts = attempts.groupBy(F.col("problem").alias("name"), "method", "outcome").agg(F.count("*").alias("n"))
    logs = counts.withColumn("part", F.coalesce(factor, F.lit(1.0)))
    return logs.groupBy("name", "method").agg(F.exp(F.sum(F.col("n") * F.log("part"))).alias("experience"))


def action_motifs(traces: DataFrame, least: int = 2) -> DataFrame:
    """(first, second, count, successes): methods that follow one another in a trace (problem, step, method, outcome)."""
    order = Window.partitionBy("problem").orderBy("step")
    pairs = traces.filter("step is not null").withColumn("second", F.lead("method").over(order)).withColumn("ends", F.lead("outcome").over(order)).filter("second is not null")
    return pairs.groupBy(F.col("method").alias("first"), "second").agg(F.count("*").alias("count"), F.count_if(F.col("ends") == "succeeded").alias("successes")).filter(F.col("count") >= least)


def theory_profile(objects: DataFrame) -> DataFrame:
    """(theory, tag, n) of (theory, tags)."""
    return objects.select("theory", F.explode("tags").alias("tag")).groupBy("theory", "tag").agg(F.count("*").alias("n"))


def bridges(profiles: DataFrame, methods: list[dict], top: int = 10) -> DataFrame:
    """(from, to, method, score): methods that fit one theory and whose products another already has.

    profiles: (theory, tags), one row a theory.
    """
    a = profiles.select(F.col("theory").alias("from"), F.col("tags").alias("s"))
    b = profiles.select(F.col("theory").alias("to"), F.col("tags").alias("t"))
    # Theories pair up through a tag they share or a method that fits one and echoes in the other: by the method.
    fit = a.select("from", "s", F.explode(catalogue(methods)).alias("m")).withColumn("fit", part_present(F.col("m.recognizes"), F.col("s"))).filter("fit > 0")
    fit = fit.filter(F.size(F.array_except("m.unlocks", "s")) > 0).withColumn("method", F.col("m.method"))
    echo = b.select("to", "t", F.explode(catalogue(methods)).alias("k")).withColumn("echo", part_present(F.col("k.unlocks"), F.col("t"))).filter("echo > 0").withColumn("method", F.col("k.method"))
    both = fit.join(echo, "method").filter(F.col("from") != F.col("to"))
    union = F.size(F.array_union("s", "t"))
    distance = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("s", "t")) / union)
    scored = both.withColumn("score", F.col("fit") * F.col("echo") * (0.65 + 0.35 * distance))
    return scored.select("from", "to", "method", "score").orderBy(F.round("score", 9).desc(), "method", "from", "to").limit(top)


def benchmark(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, rank, hit, reciprocal): of each case the best rank of an expected method, excluded ones removed first.

    ranked: (name, method, rank); cases: (id, problem, expected, excluded, top_k).
    """
    rows = cases.join(ranked, cases.problem == ranked.name, "left").filter(F.col("method").isNull() | ~F.array_contains("excluded", F.col("method")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank")))
    hit = F.when(F.array_contains("expected", F.col("method")), F.col("place"))
    out = rows.groupBy("id").agg(F.min(hit).alias("rank"), F.first("top_k").alias("top_k"))
    return out.select("id", "rank", F.coalesce(F.col("rank") <= F.col("top_k"), F.lit(False)).alias("hit"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal"))


def explore(objects: DataFrame, methods: list[dict], depth: int = 3, beam: int = 12, least: float = 0.25, most_nodes: int = 256) -> DataFrame:
    """(name, path, tags, depth, score, breadth): views that sequences of methods open, by beam search for all objects at once.

    A level explodes the catalogue beside each state of the beam, keeps steps that fit and add a tag, and picks `beam` of
    an object's proposals with the penalty for repeated families. States with the same tags are one, with the better
    path. The beam bounds an object's states to depth * beam + 1, which must not exceed most_nodes.
    """
    if depth * beam + 1 > most_nodes:
        raise ValueError("the beam and depth allow more states than most_nodes")
    every, tags = catalogue(methods), F.col("tags")
    start = objects.select("name", F.array_sort(F.array_distinct("tags")).alias("tags")).withColumn("key", F.array_join("tags", ","))
    nodes = start.select("name", "key", "tags", F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), breadth(every, tags).alias("breadth"))
    nodes = checkpoint(nodes)
    front = nodes.withColumn("place", F.lit(1))
    for level in range(depth):
        step = front.withColumn("m", F.explode(every)).withColumn("fit", part_present(F.col("m.recognizes"), tags)).withColumn("added", F.array_except("m.unlocks", "tags"))
        step = step.filter((F.col("fit") >= least) & (F.size("added") > 0)).withColumn("after", F.array_sort(F.array_union(tags, F.col("added"))))
        step = step.withColumn("wide", breadth(every, F.col("after"))).withColumn("novelty", F.size("added") / F.size("m.unlocks"))
        gain = F.least(F.greatest(F.col("wide") - F.col("breadth"), F.lit(0)) / 5, F.lit(1.0))
        first = BASE + DISTANCE * (1 - part_present(F.col("m.native"), tags)) + (BRIDGE + NOVELTY) * F.col("novelty") + BREADTH * gain
        later = 0.66 + 0.20 * F.col("novelty") + 0.14 * gain
        step = step.withColumn("made", F.col("score") * F.col("fit") * (first if level == 0 else later) * 0.94**level)
        family = Window.partitionBy("name", "m.family").orderBy(F.round("made", 12).desc(), "m.method", "place")
        step = step.withColumn("shown", F.col("made") * F.pow(F.lit(FAMILY_PENALTY), F.row_number().over(family) - 1))
        order = Window.partitionBy("name").orderBy(F.round("shown", 12).desc(), F.round("made", 12).desc(), "m.family", "m.method", "place")
        chosen = step.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam)
        chosen = chosen.select("name", F.array_join("after", ",").alias("key"), F.col("after").alias("tags"), F.concat("path", F.array("m.method")).alias("path"), F.col("made").alias("score"), "wide", "r")
        best = chosen.groupBy("name", "key").agg(F.min("r").alias("r"), F.max(F.struct("score", (-F.col("r")).alias("o"), "path")).alias("b"), F.first("tags").alias("t"), F.first("wide").alias("w"))
        old = nodes.select("name", "key", *(F.col(c).alias(f"old_{c}") for c in ("tags", "path", "depth", "score", "breadth")))
        both = old.join(best, ["name", "key"], "full_outer")
        better = F.col("b").isNotNull() & (F.col("old_score").isNull() | (F.col("b.score") > F.col("old_score")))
        both = checkpoint(both.select(
            "name", "key", F.coalesce("old_tags", "t").alias("tags"), F.when(better, F.col("b.path")).otherwise(F.col("old_path")).alias("path"), F.coalesce("old_depth", F.lit(level + 1)).alias("depth"),
            F.when(better, F.col("b.score")).otherwise(F.col("old_score")).alias("score"), F.coalesce("old_breadth", "w").alias("breadth"), "r",
        ))
        nodes = both.drop("r")
        place = Window.partitionBy("name").orderBy(F.round("score", 12).desc(), "r")
        front = both.filter("r is not null").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= beam).drop("r")
    return nodes.select("name", "path", "tags", "depth", "score", "breadth")
