"""Derived facts with their ways of derivation: the closure of a relation as joins, warrants as a fixpoint over ways.

A fact is written as text, relation,term,...; a way is (fact, rule, inputs). Programs are written as the joins they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.operators import graph
from stratia.session import materialize

#: Warrants by strength; what a rule derives is at most structural.
HEURISTIC, ASSERTED, STRUCTURAL, PROVED = range(4)
MOST_ROUNDS = 128


def fact(relation: str, *terms: str) -> Column:
    return F.concat_ws(",", F.lit(relation), *terms)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): reach(x, y) :- edge(x, y). reach(x, z) :- reach(x, y), edge(y, z). A node on a cycle reaches itself."""
    edges = edges.select("src", "dst").distinct()
    # reach() leaves out a source itself; it is reached if one of the nodes before it is, or if it has a loop.
    found = graph.reach(edges, edges.select(F.col("src").alias("source")))
    back = found.join(edges, (found.node == edges.src) & (found.source == edges.dst), "left_semi").select(F.col("source").alias("src"), F.col("source").alias("dst"))
    return found.select(F.col("source").alias("src"), F.col("node").alias("dst")).union(back).union(edges.filter("src = dst")).distinct()


def closure_ways(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(fact, rule, inputs): every way in which either rule gives a fact of the closure."""
    edges = edges.select("src", "dst").distinct()
    base = edges.select(fact("reach", "src", "dst").alias("fact"), F.lit("base").alias("rule"), F.array(fact("edge", "src", "dst")).alias("inputs"))
    step = reached.withColumnRenamed("dst", "via").join(edges.withColumnRenamed("src", "via"), "via")
    return base.union(step.select(fact("reach", "src", "dst"), F.lit("step"), F.array(fact("reach", "src", "via"), fact("edge", "via", "dst"))))


def warrants(ways: DataFrame, given: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(fact, warrant): of derived facts the best of their ways, a way being as good as its weakest input.

    given: (fact, warrant) of source facts, which derivations don't change. Derived facts start as heuristic and rise.
    """
    sources = materialize(given.select("fact", F.col("warrant").cast("int").alias("warrant")), "given")
    # Rounds move numbers of facts and ways; texts are met before and after them alone.
    derived = ways.select("fact", "inputs").join(sources.select("fact").hint("merge"), "fact", "left_anti")
    held = materialize(derived.withColumn("way", F.monotonically_increasing_id()), "ways")
    said = held.select("way", "fact", F.explode("inputs").alias("input"))
    facts = said.select("fact").union(said.select("input")).union(sources.select("fact")).distinct()
    facts = materialize(facts.withColumn("f", F.monotonically_increasing_id()), "facts")
    numbers = lambda text, as_: facts.select(F.col("fact").alias(text), F.col("f").alias(as_)).hint("merge")
    steps = said.join(numbers("input", "i"), "input").select("way", "fact", "i").join(numbers("fact", "f"), "fact").select("way", "f", "i")
    steps = materialize(steps, "steps")
    fixed = materialize(sources.join(numbers("fact", "f"), "fact").select("f", "warrant"), "given")
    state = fixed.union(steps.select("f").distinct().withColumn("warrant", F.lit(HEURISTIC)))
    for _ in range(most):
        of = steps.join(state.select(F.col("f").alias("i"), "warrant").hint("merge"), "i", "left")
        each = of.groupBy("f", "way").agg(F.least(F.min(F.coalesce("warrant", F.lit(HEURISTIC))), F.lit(STRUCTURAL)).alias("w"))
        best = each.groupBy("f").agg(F.max("w").cast("int").alias("warrant"))
        new = materialize(fixed.union(best), "warrants")
        if new.join(state.hint("merge"), ["f", "warrant"], "left_anti").isEmpty():
            return facts.join(new.hint("merge"), "f").select("fact", "warrant")
        state = new
    raise RuntimeError(f"warrants still rise after {most} rounds")


def explain(ways: DataFrame, warranted: DataFrame) -> DataFrame:
    """(fact, rule, inputs, missing, warrant): of each derived fact its strongest way, first by rule and inputs on ties."""
    held = materialize(ways.select("fact", "rule", "inputs").withColumn("way", F.monotonically_increasing_id()), "ways")
    rows = held.select("way", F.explode("inputs").alias("input"))
    rows = rows.join(warranted.select(F.col("fact").alias("input"), F.col("warrant").alias("w")).hint("merge"), "input", "left")
    each = rows.groupBy("way").agg(F.least(F.min(F.coalesce("w", F.lit(HEURISTIC))), F.lit(STRUCTURAL)).alias("warrant"), F.count_if(F.col("w").isNull()).alias("missing"))
    each = held.withColumn("inputs", F.array_join("inputs", "&")).join(each.hint("merge"), "way")
    return each.groupBy("fact").agg(F.min(F.struct((-F.col("warrant")).alias("o"), "rule", "inputs", "missing", "warrant")).alias("b")).select("fact", "b.rule", "b.inputs", "b.missing", "b.warrant")


def _capped(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.least(F.col("warrant").cast("int"), F.lit(STRUCTURAL)).alias("warrant")).filter("src is not null and dst is not null")


def _below(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, reached), both (src, dst, warrant), of sources that an edge leads to: their edges, and what these lead to by the best path.

    Rounds go on from the rows that have become better.
    """
    best = lambda df: df.groupBy("src", "dst").agg(F.max("warrant").alias("warrant"))
    steps = materialize(best(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")), "steps")
    on = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("warrant").alias("w")).hint("merge")
    seen = frontier = steps
    for i in range(1, graph.MAX_ROUNDS):
        step = best(frontier.join(on, "dst").select("src", F.col("to").alias("dst"), F.least("warrant", "w").alias("warrant")))
        known = best(seen).withColumnRenamed("warrant", "known").hint("merge")
        frontier = materialize(step.join(known, ["src", "dst"], "left").filter("known is null or known < warrant").drop("known"), "reached")
        if frontier.isEmpty():
            return steps, materialize(best(seen), "reached")
        seen = seen.union(frontier)
        seen = seen if i % graph.COMPACT else materialize(best(seen), "reached")
    raise RuntimeError(f"no end after {graph.MAX_ROUNDS} rounds")


def closure_warrants(edges: DataFrame) -> DataFrame:
    """(src, dst, warrant) of the facts of closure(), as warrants() finds them; edges: (src, dst, warrant), of equal ones the best counts.

    What a source reaches is what its edges' ends do, so that only ends are searched from, and sources meet them once. Names
    move, and not the texts of facts.
    """
    edges = _capped(edges)
    _, reached = _below(edges)
    on = reached.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("warrant").alias("w")).hint("merge")
    step = edges.join(on, "dst").select("src", F.col("to").alias("dst"), F.least("warrant", "w").alias("warrant"))
    return edges.union(step).groupBy("src", "dst").agg(F.max("warrant").alias("warrant"))


def closure_explained(edges: DataFrame) -> DataFrame:
    """(src, dst, via, warrant): closure_warrants() with the way that explain() finds: the node before dst, null where it is the edge itself."""
    edges = _capped(edges)
    steps, reached = _below(edges)
    last = steps.select(F.col("src").alias("via"), "dst", F.col("warrant").alias("w")).hint("merge")
    ways = reached.select("src", F.col("dst").alias("via"), "warrant").join(last, "via").select("src", "via", "dst", F.least("warrant", "w").alias("warrant"))
    # The inputs of a fact's ways differ from here on; what stands before it is the same.
    text = F.concat("via", F.lit("&edge,"), "via", F.lit(","), "dst")
    # Behind a weak edge stronger ways are equal, so that of each warrant the first way is kept.
    ways = steps.select("src", F.col("src").alias("via"), "dst", "warrant").union(ways)
    ways = materialize(ways.groupBy("src", "dst", "warrant").agg(F.min(F.struct(text.alias("text"), "via"))["via"].alias("via")), "ways")
    on = ways.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "via", F.col("warrant").alias("w")).hint("merge")
    step = edges.join(on, "dst").select("src", F.col("to").alias("dst"), "via", F.least("warrant", "w").alias("warrant"))
    every = edges.select("src", "dst", F.lit(None).cast("string").alias("via"), "warrant").union(step).repartition("src")  # so that texts are not moved
    order = F.struct((-F.col("warrant")).alias("o"), F.col("via").isNotNull().alias("step"), text.alias("text"), "via", "warrant")
    return every.groupBy("src", "dst").agg(F.min(order).alias("b")).select("src", "dst", "b.via", "b.warrant")
