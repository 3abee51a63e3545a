"""Queries over whole tables against brute force, over fixtures with hot statements."""

from collections import Counter, defaultdict
from math import log

import pytest

import __spark_entry__ as entry
from stratia.functions import terms
from stratia.operators import statements as st
from stratia.plans import evidence, graph, logic
from stratia.plans import statements as plans
from stratia.sources import derived

PARTS = "seq long, name string, kind string, module string, stmt string"


def part(brand, kind, size, bucket, layers):
    core = f"a(a(a(a(c(4:Part,0),c({len(brand)}:{brand},0)),c({len(kind)}:{kind},0)),n{size}),n{bucket})"
    return "x-stmt-v1;" + "a(c(1:f,0)," * layers + core + ")" * layers


@pytest.fixture(scope="module")
def corpus():
    """190 declarations: 70 copies of one statement, and others of few brands, types and layers."""
    texts = [part("B1", "T1", 1, 1, 1)] * 70 + [part(f"B{i % 3}", f"T{i % 5}", i % 7, i % 2, i % 3) for i in range(120)]
    return [(i, f"part:{i}", "theorem", f"Mfgr.B{i % 3}.T", t) for i, t in enumerate(texts)]


@pytest.fixture
def hot(spark, corpus, monkeypatch):
    monkeypatch.setattr(derived, "declarations", lambda s, d: spark.createDataFrame(corpus, PARTS))
    monkeypatch.setattr(st, "CHUNK", 16)
    return corpus


def subterm_keys(text):
    return {terms.render(t) for t in terms.walk(terms.parse(text)) if terms.size(t) >= (st.CLOSED if terms.loose(t) == 0 else st.OPEN)}


def source_keys(text):
    shape = terms.erase(terms.parse(text), "shape", {})
    return {"A" + terms.render(shape)} | {"B" + k for k in subterm_keys(text)} | {"C" + terms.render(t) for t in terms.walk(shape) if terms.size(t) >= st.SHAPE}


def brute(corpus, keys_of):
    """name: [(sort key, other, scores, rarity)] of all that share a key."""
    total, keys = len(corpus), {t: keys_of(t) for t in {r[4] for r in corpus}}
    df = Counter(k for r in corpus for k in keys[r[4]])
    scored, out = {}, defaultdict(list)
    for _, a, _, _, x in corpus:
        for _, b, _, _, y in corpus:
            shared = keys[x] & keys[y]
            if a == b or not shared:
                continue
            if (x, y) not in scored:
                scored[x, y] = terms.scores(terms.parse(x), terms.parse(y)), max(log(total / df[k]) for k in shared)
            s, rarity = scored[x, y]
            score = s["retention"] * (1 + st.RARITY * min(rarity / log(total), 1)) * (1 - st.SCOPED * s["scoped"] / max(s["vars"], 1))
            out[a].append(((-round(score, 9), -s["common"], s["vars"], b), s))
    return out


def best(found):
    return {(a, x[3], i) for a, rows in found.items() for i, (x, _) in enumerate(sorted((r for r in rows if r[1]["common"] >= st.LEAST_COMMON and r[1]["retention"] >= st.LEAST_SCORE), key=lambda r: r[0])[:10], 1)}


def test_similar_topk_keeps_hot_statements(spark, hot):
    want = best(brute(hot, source_keys))
    got = {(r.name, r.other, r["rank"]) for r in plans.similar_topk(spark, "").collect()}
    assert got == want and len({a for a, _, _ in got}) == len(hot)


def test_sources_reach_pairs_of_equal_shape_alone(spark, hot):
    a, b = part("X", "U", 100, 50, 2), part("Y", "V", 101, 51, 2)
    assert not subterm_keys(a) & subterm_keys(b)
    assert {k[0] for k in source_keys(a) & source_keys(b)} == {"A", "C"}
    hot = [(i, f"part:{i}", "theorem", "Mfgr.B.T", t) for i, t in enumerate([a, b, part("Z", "W", 102, 52, 3)])]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(derived, "declarations", lambda s, d: spark.createDataFrame(hot, PARTS))
        got = {(r.name, r.other) for r in plans.similar_topk(spark, "").collect()}
        assert {(x, y) for x, y, _ in best(brute(hot, source_keys))} == got >= {("part:0", "part:1"), ("part:1", "part:0")}


def test_dictionary_meets_other_shapes(spark):
    texts = [("A", part("A", "T", 1, 1, 5)), ("A", part("A", "T", 2, 2, 1)), ("A", "x-stmt-v1;n1"), ("B", part("B", "T", 1, 1, 4)), ("B", part("B", "T", 1, 1, 4)), ("B", part("C", "U", 3, 3, 1))]
    rows = [(i, f"part:{i}", "theorem", f"Mfgr.{m}.T", t) for i, (m, t) in enumerate(texts)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(derived, "declarations", lambda s, d: spark.createDataFrame(rows, PARTS))
        want = {}
        for _, a, _, _, x in rows[:3]:
            found = []
            for _, b, _, _, y in rows[3:]:
                s = terms.scores(terms.parse(x), terms.parse(y))
                if source_keys(x) & source_keys(y) and s["common"] >= st.LEAST_COMMON and s["retention"] >= st.LEAST_SCORE:
                    found.append((-round(s["retention"] * (1 - st.SCOPED * s["scoped"] / max(s["vars"], 1)), 9), -s["common"], s["vars"], b))
            if found:
                want[a] = min(found)[3]
        assert {r.name: r.other for r in plans.dictionary(spark, "").collect()} == want
        assert {r.name for r in plans.dictionary_missing(spark, "").collect()} == {"part:0", "part:1", "part:2"} - want.keys()
        assert want["part:0"] == "part:3"


def test_score_variants_counts_all_members(spark, hot):
    found = brute(hot, source_keys)
    kept = {a: [s for _, s in rows if s["common"] >= st.LEAST_COMMON] for a, rows in found.items()}
    want = {a: (len(x), round(max(s["dice"] for s in x), 6), max(s["common"] for s in x)) for a, x in kept.items() if x}
    assert {r.name: (r.n, r.dice, r.common) for r in plans.score_variants(spark, "").collect()} == want


def test_postings_idf_has_every_key(spark, hot):
    df = Counter(k for r in hot for k in subterm_keys(r[4]))
    assert {r.key: r.n for r in plans.postings_idf(spark, "").collect()} == df
    assert max(r.n for r in plans.motifs(spark, "").collect()) > 70
    assert {r.name for r in plans.work_budget(spark, "").collect()} == {r[1] for r in hot}


def test_information_weighs_members(spark, hot):
    df = Counter(k for r in hot for k in set(terms.symbols(terms.parse(r[4]))))
    weigh = lambda t: sum(log(len(hot) / df[k]) for k in terms.symbols(t))
    want, known = {}, {}
    for a, rows in brute(hot, source_keys).items():
        x, values = next(r[4] for r in hot if r[1] == a), []
        for key, _ in rows:
            y = hot[int(key[3].split(":")[1])][4]
            if (x, y) not in known:
                s, t = terms.parse(x), terms.parse(y)
                known[x, y] = 2 * weigh(terms.generalise(s, t)[0]) / (weigh(s) + weigh(t))
            values.append(known[x, y])
        want[a] = (len(values), max(values), sum(values) / len(values))
    got = {r.name: (r.n, r.best_info_dice, r.mean_info_dice) for r in evidence.information(spark, "").collect()}
    assert got.keys() == want.keys()
    assert all(got[a][0] == n and got[a][1:] == pytest.approx((b, m), abs=2e-6) for a, (n, b, m) in want.items())


def test_every_name_is_a_source(spark):
    """Against a search by hand over the smallest tables; test_queries holds the same queries against their SQL."""
    names = {r.name for r in derived.names(spark, entry.SMOKE).collect()}
    down, proofs = defaultdict(set), defaultdict(set)
    for r in derived.edges(spark, entry.SMOKE).collect():
        down[r.src].add(r.dst)
        if r.lens == "proof":
            proofs[r.src].add(r.dst)

    def reached(start, steps):
        found, todo = set(), [start]
        while todo:
            new = steps.get(todo.pop(), set()) - found
            found |= new
            todo += new
        return found

    below = {n: reached(n, down) for n in names}
    assert {r.source: r.n for r in graph.foundations_all(spark, entry.SMOKE).collect()} == {n: len(x) for n, x in below.items() if x}
    above = Counter(x for found in below.values() for x in found)
    got = {r.source: r.n for r in graph.bridge_centrality(spark, entry.SMOKE).collect()}
    assert got == {n: above[n] for n in names} and any(n for s, n in got.items() if s.startswith("supplier:"))
    pairs = {(r.src, r.dst) for r in logic.datalog_reach(spark, entry.SMOKE).collect()}
    assert pairs == {(a, b) for a in list(proofs) for b in reached(a, proofs)} and any(a.startswith("order:") for a, _ in pairs)


def test_hypothesis_homes_keeps_suppliers_and_projections(spark):
    whole = {tuple(r) for r in evidence.hypothesis_homes(spark, entry.SMOKE).collect()}
    binders, _, _ = evidence._lattice(spark, entry.SMOKE)
    assert {r[0] for r in whole} == {r.name for r in binders.select("name").distinct().collect()}
    assert {r[0].split(":")[0] for r in whole} >= {"order", "supplier"}
