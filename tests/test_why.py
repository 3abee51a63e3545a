"""Shortest paths backwards from few targets, against a search by hand; rows of the search go by edges, not by targets."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from stratia.operators import graph


def test_paths_back_from_targets_equal_a_plain_search(spark):
    r = random.Random(9)
    pairs = [(f"v{r.randrange(40)}", f"v{r.randrange(25)}") for _ in range(90)] + [("v1", "v1"), ("v2", "v3"), ("v3", "v2"), ("v2", None)] + [("lone", "t0")]
    pairs += [(f"v{k}", f"t{k % 3}") for k in range(5, 12)] + [("t1", "v5")]
    pairs += pairs[:5]
    steps = {}
    for a, b in pairs:
        if b:
            steps.setdefault(a, set()).add(b)
    sources = {x for p in pairs for x in p if x and x != "lone"}
    want = {}
    for s in sources:
        best, front = {s: (s,)}, {s: (s,)}
        while front:
            new = {}
            for n, path in front.items():
                for b in steps.get(n, ()):
                    if b not in best and (b not in new or path + (b,) < new[b]):
                        new[b] = path + (b,)
            best |= new
            front = new
        want |= {(s, t): list(p) for t, p in best.items() if t.startswith("t")}
    edges = spark.createDataFrame([(a, b, "proof") for a, b in pairs], "src string, dst string, lens string")
    got = graph.why(edges, spark.createDataFrame([(s,) for s in sources], "source string"), F.col("node").startswith("t")).collect()
    assert {(x.source, x.target): x.path for x in got} == want and len(got) == len(want)
    assert all(b in steps[a] for x in got for a, b in pairwise(x.path))


def test_a_round_has_a_row_a_node(spark, monkeypatch):
    """60 nodes that reach 20 targets each: the search writes a row for each node, not one for each node and target."""
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name, codec=None: written.append((name, keep(df, name, codec))) or written[-1][1])
    edges = spark.range(60).crossJoin(spark.range(20).toDF("t")).select(F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("t"), "t").alias("dst"), F.lit("proof").alias("lens"))
    sources = spark.range(60).select(F.concat(F.lit("s"), "id").alias("source"))
    assert graph.why(edges, sources, F.col("node").startswith("t")).count() == 1200
    assert [df.count() for name, df in written if name == "why"] == [20, 60, 0]
