"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from stratia.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, distance string"


def plain(rows, k=8, rounds=10, dimension=64):
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in hashed[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        c = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else old for g, old in zip(groups, c, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = [sum(d for _, d, j in found if j == n) for n in range(len(c))]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, j, long(d), long(by[j]), long(sum(by)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def vectors(rng, n, scale=1.0, d=64):
    middle = [[rng.gauss(0, scale) for _ in range(d)] for _ in range(5)]
    return [[x + rng.gauss(0, scale / 4) for x in rng.choice(middle)] for _ in range(n)]


def run(spark, rows, **more):
    return centroids.assigned(*centroids.cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), **more)).collect()


def test_equals_plain_version_with_bad_rows_and_copies(spark):
    rng = random.Random(2)
    rows = list(enumerate(vectors(rng, 150)))
    rows += rows[4:9] + [(500 + i, rows[7][1]) for i in range(60)] + [(None, rows[3][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [math.nan] * 64), (905, [math.inf] * 64), (906, [0.0] * 64), (907, [-0.0] * 64)]
    same(run(spark, rows), plain(rows))


def test_values_over_the_bound_of_doubles_and_of_longs(spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(rng, 30))) + list(enumerate(vectors(rng, 20, 1e4), 100)) + list(enumerate(vectors(rng, 6, 1e12), 200)) + list(enumerate(vectors(rng, 4, 1e200), 300))
    got = run(spark, rows)
    same(got, plain(rows))
    assert any(r.distance is None for r in got) and any(r.distance is not None for r in got)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e8, 1e15])
def test_distances_are_exact_at_every_tier(scale):
    rng = np.random.default_rng(int(scale) % 97)
    x = np.floor(rng.normal(size=(40, 64)) * scale * 1024)
    x[:20] = np.floor(rng.normal(size=(20, 64)) * 1000)
    x = np.array([[int(v) for v in row] for row in x], object)
    x = x if max(abs(v) for v in x.ravel()) >= 1 << 62 else x.astype(np.int64)
    c = x[15:23]
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert [[int(v) for v in r] for r in centroids.distances(x, c)] == want


def test_ties_few_rows_and_empty_table(spark):
    same(run(spark, [(1, [1.0] * 64), (2, [1.0] * 64)]), plain([(1, [1.0] * 64), (2, [1.0] * 64)]))
    two = [(i, [float(i % 2)] * 64) for i in range(40)]
    same(run(spark, two), plain(two))
    assert run(spark, [], k=3) == []
    assert run(spark, [(1, [0.5] * 3)], dimension=3)[0].cluster == 0
    with pytest.raises(ValueError, match="power"):
        run(spark, two, scale=1000)


def test_tiles_of_any_size_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(vectors(rng, 90)))
    want = sorted(map(tuple, run(spark, rows)), key=key)
    monkeypatch.setattr(centroids, "TILE", 7)
    assert sorted(map(tuple, run(spark, rows)), key=key) == want


def test_query_equals_plain_version_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    same(centroids.op13_centroids(spark, d).collect(), plain(rows))
