"""Closures with packed sets against a search by hand, and the rows that they move."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratia.functions import packed
from stratia.operators import graph


def test_rows_are_packed_and_joined_run_by_run():
    r = random.Random(3)
    rows = [(f"n{k // 9}", k % 3 // 2, sorted({r.choice([r.randrange(9), r.randrange(1 << packed.SHIFT)]) for _ in range(1 + k % 7)})) for k in range(90)]
    rows.sort(key=lambda x: x[:2])
    sets = packed.pack(np.concatenate([x for *_, x in rows]), np.array([len(x) for *_, x in rows]))
    places, counts = packed.unpack(sets.slice(4, 20))
    assert places.tolist() == sum((x for *_, x in rows[4:24]), []) and counts.tolist() == [len(x) for *_, x in rows[4:24]]
    b = pa.RecordBatch.from_arrays([pa.array([n for n, *_ in rows]), pa.array([c for _, c, _ in rows], pa.int32()), sets], names=["node", "chunk", "set"])
    want, got = {}, {}
    for n, c, x in rows:
        want.setdefault((n, c), set()).update(x)
    for out in packed.sweep((b.slice(i, 7) for i in range(0, 90, 7)), packed.ROW):
        row, number = packed.numbers(out)
        for i, (n, c) in enumerate(zip(out["node"].to_pylist(), out["chunk"].to_pylist(), strict=True)):
            assert (n, c) not in got
            got[n, c] = set((number[row == i] - (c << packed.SHIFT)).tolist())
    assert got == want


def test_sizes_and_centrality_on_cycles_loops_and_nulls(spark):
    r = random.Random(5)
    pairs = [(f"v{r.randrange(30)}", f"v{r.randrange(12)}") for _ in range(40)] + [("v1", "v1"), ("v2", "v3"), ("v3", "v2"), ("v2", None), (None, "v4")]
    edges = spark.createDataFrame([(a, b, "proof") for a, b in pairs], "src string, dst string, lens string")
    names = {x for p in pairs for x in p if x} | {"alone"}
    below = {n: set() for n in names}
    for _ in names:
        for a, b in pairs:
            if a and b:
                below[a] |= {b} | below[b]
    below = {n: x - {n} for n, x in below.items()}
    sources = spark.createDataFrame([(n,) for n in names], "source string")
    got = {x.source: (x.n, x.first_node) for x in graph.foundation_sizes(edges, sources).collect()}
    assert got == {n: (len(x), min(x)) for n, x in below.items() if x}
    assert {x.source: x.n for x in graph.bridge_centrality(edges, sources).collect()} == {n: sum(n in x for x in below.values()) for n in names}


def test_a_source_that_nothing_leads_to_has_a_row_an_edge(spark):
    """200 sources reach 200 nodes over one: a row for each source, not one for each of the 40,000 pairs."""
    edges = spark.range(200).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit("proof").alias("lens"))
    edges = edges.union(spark.range(200).select(F.lit("hub"), F.concat(F.lit("t"), "id"), F.lit("proof")))
    _, sets, outer = graph._followed(edges, "both")
    assert outer.count() == 200 and sets.count() == 201
    found = graph.foundation_sizes(edges, spark.createDataFrame([("s7",)], "source string")).collect()
    assert [tuple(r) for r in found] == [("s7", 201, "hub")]


def test_only_what_is_reached_twice_is_listed():
    """By n, of number 2, in three rows cut over batches: 5 twice, its own number once, 9 once; m reaches 5 once."""
    rows = [("m", None, [5]), ("n", 2, [2, 5]), ("n", 2, [9]), ("n", 2, [5])]
    sets = packed.pack(np.concatenate([x for *_, x in rows]), np.array([len(x) for *_, x in rows]))
    b = pa.RecordBatch.from_arrays([pa.array([n for n, *_ in rows]), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([0] * 4, pa.int32()), sets], names=["node", "i", "chunk", "set"])
    for size in (1, 2, 3, 4):
        found = [tuple(r.values()) for out in packed.repeated(b.slice(i, size) for i in range(0, 4, size)) for r in out.to_pylist()]
        assert sorted(found) == [("n", 2, 1), ("n", 5, 1)]
