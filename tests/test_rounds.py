"""Rounds of warrants move numbers, not texts."""

import random

from pyspark.sql import functions as F

from stratia.operators import derivations


def test_steps_of_warrants_are_numbers(spark, monkeypatch):
    kinds, plain = {}, derivations.materialize
    monkeypatch.setattr(derivations, "materialize", lambda df, name: (kinds.setdefault(name, [t for _, t in df.dtypes]), plain(df, name))[1])
    ways = spark.createDataFrame([("c", "r", ["a", "b"]), ("d", "r", ["c"]), ("d", "s", ["x"])], "fact string, rule string, inputs array<string>")
    given = spark.createDataFrame([("a", 3), ("b", 1)], "fact string, warrant int")
    assert sorted(map(tuple, derivations.warrants(ways, given).collect())) == [("a", 3), ("b", 1), ("c", 1), ("d", 1)]
    assert kinds["steps"] == ["bigint"] * 3


def test_closures_are_explained_by_names(spark, monkeypatch):
    """As the ways of all facts say, on cycles and where names come before "&"; what nothing leads to is only in the result."""
    rng = random.Random(4)
    nodes = ["1", "12", "1!", "2", "3&", "4", "44", "5"]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(11)} | {(f"leaf{i}", rng.choice(nodes)) for i in range(40)} | {("1", "12"), ("12", "1")}
    rows = [(a, b, rng.randrange(4)) for a, b in sorted(pairs)]
    edges = spark.createDataFrame(rows, "src string, dst string, warrant int").cache()
    ways = derivations.closure_ways(edges, derivations.closure(edges)).cache()
    known = derivations.warrants(ways, edges.select(derivations.fact("edge", "src", "dst").alias("fact"), "warrant")).cache()
    want = sorted((r.fact, r.inputs, r.warrant) for r in derivations.explain(ways, known).collect())
    kept, plain = [], derivations.materialize
    monkeypatch.setattr(derivations, "materialize", lambda df, name: (kept.append(plain(df, name)), kept[-1])[1])
    step = F.concat_ws("&", derivations.fact("reach", "src", "via"), derivations.fact("edge", "via", "dst"))
    inputs = F.when(F.col("via").isNull(), derivations.fact("edge", "src", "dst")).otherwise(step)
    found = derivations.closure_explained(edges.union(edges.withColumn("warrant", F.lit(0))))
    got = sorted(tuple(r) for r in found.select(derivations.fact("reach", "src", "dst"), inputs, "warrant").collect())
    assert got == want and len({w for *_, w in want}) == 3
    each = derivations.closure_warrants(edges).select(derivations.fact("reach", "src", "dst"), "warrant")
    assert sorted(map(tuple, each.collect())) == sorted(tuple(r) for r in known.filter("fact like 'reach%'").collect())
    assert all(df.filter("src like 'leaf%'").isEmpty() and not {"fact", "inputs"} & set(df.columns) for df in kept)
