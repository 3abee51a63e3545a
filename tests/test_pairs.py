"""Matrices of pairs against terms.scores, pair by pair."""

import random

import pandas as pd
from pyspark.sql import functions as F

from stratia.functions import pairs, terms
from stratia.operators import statements as st


def made(rng, depth, bound=0):
    """A random term with binders, free variables, holes and repeated parts."""
    leaf = lambda: rng.choice([("c", (rng.choice("fgh"), ())), ("n", rng.choice("12")), ("b", rng.randrange(bound + 2)), terms.HOLE, ("s", "0"), ("t", "x")])
    if depth == 0 or rng.random() < 0.2:
        return leaf()
    tag = rng.choice("aaaaplej")
    if tag == "a":
        return ("a", "", made(rng, depth - 1, bound), made(rng, depth - 1, bound))
    if tag in "pl":
        return (tag, rng.choice("di"), made(rng, depth - 1, bound), made(rng, depth - 1, bound + 1))
    if tag == "e":
        return ("e", "", made(rng, depth - 1, bound), made(rng, depth - 1, bound), made(rng, depth - 1, bound + 1))
    return ("j", ("P", rng.randrange(2)), made(rng, depth - 1, bound))


def test_matrices_equal_scores_of_pairs():
    rng = random.Random(3)
    left, right = ([terms.render(made(rng, rng.randrange(5))) for _ in range(60)] for _ in range(2))
    right[:20] = left[:20]
    common, n, scoped, a, b = pairs.compared(left, right, pairs.counted)
    parsed = [[terms.parse("x-stmt-v1;" + t) for t in side] for side in (left, right)]
    for i, x in enumerate(parsed[0]):
        for j, y in enumerate(parsed[1]):
            s = terms.scores(x, y)
            assert (common[i, j], n[i, j], scoped[i, j], a[i], b[j]) == (s["common"], s["vars"], s["scoped"], s["left"], s["right"]), (left[i], right[j])
    assert n.max() > 2 and scoped.max() > 0


def test_each_pair_meets_in_one_group(spark):
    """By the last of its keys, with keys of over a chunk and small ones, and as often as meetings() says."""
    rng = random.Random(5)
    rows = sorted({(f"n{i:02}", k, float(len(k))) for i in range(40) for k in ("every", *(rng.choice(["a", "bb", "ccc", "dddd"]) for _ in range(2)), f"own-{i:08}")})
    keys = spark.createDataFrame(rows, "name string, key string, idf double")
    reps = keys.select("name").distinct()

    def run(pdf):
        out = [(a["name"].iloc[i], b["name"].iloc[j], idf) for idf, a, b, met in st._met(pdf) for i, j in zip(*met.nonzero(), strict=True)]
        return pd.DataFrame([(*sorted(r[:2]), r[2]) for r in out], columns=["name", "other", "rarity"])

    got = sorted(map(tuple, st.tiles(keys, reps, chunk=7).applyInPandas(run, "name string, other string, rarity double").collect()))
    assert got == sorted(tuple(r) for r in st.meetings(keys, 7).filter("name < other").collect()) and len(got) == 40 * 39 // 2


def test_best_measures_are_those_of_pairs_and_compare_none_alone(spark, monkeypatch):
    """Sums over groups against compare_classes() over meetings(); terms of different classes never meet as rows."""
    stmts = [f"a(a(a(a(c(1:R,0),c(1:{x},0)),c(1:y,0)),c(1:{y},0)),n{i % 3})" for i, (x, y) in enumerate((x, y) for x in "abcdef" for y in "uvw")] + ["n1", "a(c(1:R,0),n1)"]
    reps = spark.createDataFrame([(f"d{i:02}", t, i % 2 + 1) for i, t in enumerate(stmts)], "name string, erased string, n long").cache()
    keys = spark.createDataFrame([(f"d{i:02}", k, float(len(k))) for i, t in enumerate(stmts) for k in {"every", t[:22], f"n-{t[-3:]}"}], "name string, key string, idf double").cache()
    kept = st.compare_classes(st.meetings(keys), reps).filter(F.col("common") >= st.LEAST_COMMON).groupBy("name").agg(F.sum("n"), *(F.round(F.max(m), 9) for m in st.MEASURES[5:]), F.max("common"))
    want = sorted(map(tuple, kept.collect()))
    monkeypatch.setattr(st, "CHUNK", 5)
    plain, given = st.compare_classes, []
    monkeypatch.setattr(st, "compare_classes", lambda pairs, reps: (given.append(pairs), plain(pairs, reps))[1])
    found = st.best_measures(keys, reps)
    got = sorted(map(tuple, found.select("class", "n", *(F.round(m, 9) for m in st.MEASURES[5:]), "common").collect()))
    assert got == want and len(got) == 18
    assert all(p.filter("name <> other").isEmpty() for p in given)


def test_brute_ranks_terms_before_their_copies(spark):
    """Of 300 copies of each of three terms no more than the first few names are ranked."""
    stmts = [f"a(a(a(a(c(1:R,0),c(1:x,0)),c(1:y,0)),c(1:z,0)),n{i % 3})" for i in range(900)]
    rows = spark.createDataFrame([(i, f"d{i:03}", s) for i, s in enumerate(stmts)], "seq long, name string, erased string")
    found = st.similar_brute(rows, F.col("seq") == 3, top=4)
    assert [(r["other"], r["rank"], r["common"]) for r in found.orderBy("rank").collect()] == [("d000", 1, 9), ("d006", 2, 9), ("d009", 3, 9), ("d012", 4, 9)]
    assert "cogroup" in found._jdf.queryExecution().optimizedPlan().toString().lower()
