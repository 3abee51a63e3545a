"""Ways to a proof against all pairs."""

import random

import pytest

from stratia.functions import terms
from stratia.operators import provability as pr
from stratia.operators import statements as st

V = "x-stmt-v1;"


def const(name):
    return f"c({len(name)}:{name},0)"


def app(f, *xs):
    for x in xs:
        f = f"a({f},{x})"
    return f


def made(rng):
    """Statements over a head that takes a type implicitly, so that erasing carriers leaves holes."""
    names = ["A", "B", "C", "D"]
    term = lambda n: const(rng.choice(names)) if n == 0 or rng.random() < 0.4 else app(const(rng.choice(["f", "h"])), term(n - 1)) if rng.random() < 0.5 else f"n{rng.randint(0, 2)}"
    carrier = rng.choice([const("Nat"), const("Int"), "b0"])
    return f"pi(s(+(0)),{app(const('Rel'), carrier, term(2), term(1))})" if rng.random() < 0.8 else f"pd({const('T')},{app('b0', term(1))})"


@pytest.fixture(scope="module")
def parsed(spark):
    rng = random.Random(9)
    rows = [(i, f"d{i}", "theorem" if rng.random() < 0.5 else "axiom", "M", V + made(rng)) for i in range(120)]
    rows += [(200 + i, f"e{i}", "theorem", "M", rows[i % 4][4]) for i in range(20)]
    rows.append((-1, "Rel", "def", "M", V + f"pi(s(+(0)),pd(b0,pd(b1,s(0))))"))
    decls = spark.createDataFrame(rows, "seq long, name string, kind string, module string, stmt string")
    return st.parse(decls).selectExpr("*", "kind = 'theorem' as proved").cache()


def erased(parsed, level):
    return {r.name: r.erased for r in st.erased(parsed, level).collect()}


def test_subsumers_equal_all_pairs(parsed):
    proved = {r.name for r in parsed.filter("proved").collect()}
    patterns, targets = erased(parsed, "carriers"), erased(parsed, "presentation")
    term = lambda t: terms.parse(V + t)
    want = {}
    for t in targets:
        hits = [p for p in sorted(proved) if p != t and terms.matches(term(patterns[p]), term(targets[t])) is not None]
        if hits:
            want[t] = (len(hits), hits[0])
    assert {r.name: (r.proofs, r.proof) for r in pr.subsumers(parsed).collect()} == want
    assert any(targets[t] != targets[want[t][1]] for t in want)


def test_containment_loses_no_match_and_tests_fewer_than_all(spark, parsed):
    links, patterns, targets = pr.subsumptions(parsed)
    found = pr.containing(pr._marked(patterns, "pattern"), pr._marked(targets, "target"))
    p, t = patterns.select("pattern").distinct().count(), targets.select("target").distinct().count()
    assert links.count() <= found.count() < p * t / 3


def test_patterns_without_names_and_names_that_no_target_has(spark):
    schema = "term string, front string, names array<string>"
    patterns = spark.createDataFrame([("p0", "f", []), ("p1", "f", ["x"]), ("p2", "f", ["x", "absent"]), ("p3", "g", ["x"])], schema)
    targets = spark.createDataFrame([("t0", "f", []), ("t1", "f", ["x", "y"])], schema)
    assert {tuple(r) for r in pr.containing(patterns, targets).collect()} == {("p0", "t0"), ("p0", "t1"), ("p1", "t1")}


def test_equivalents_and_conclusions_equal_all_pairs(parsed):
    rows = parsed.collect()
    for level in pr.LEVELS:
        canon = erased(parsed, level)
        want = {}
        for a in rows:
            hits = sorted(b.name for b in rows if b.proved and canon[b.name] == canon[a.name])
            if not a.proved and hits:
                want[a.name] = (len(hits), hits[0])
        assert {r.name: (r.proofs, r.proof) for r in pr.equivalents(parsed).filter(f"level = '{level}'").collect()} == want
    want = {}
    for a in rows:
        same = sorted(b.name for b in rows if b.proved and b.concludes == a.concludes)
        tree = lambda r: terms.rigid(terms.parse(V + r.concludes))
        near = sorted((b for b in rows if b.proved and tree(b)[0] == tree(a)[0]), key=lambda b: b.name)
        if not a.proved and same:
            want[a.name, "identical"] = (len(same), same[0], [])
        if not a.proved and near:
            want[a.name, "same_tree"] = (len(near), near[0].name, sorted({(x, y) for x, y in zip(tree(a)[1], tree(near[0])[1], strict=True) if x != y}))
    assert {(r.name, r.tier): (r.proofs, r.proof, [tuple(e) for e in r.edits]) for r in pr.conclusions(parsed).collect()} == want


def test_nothing_proved_gives_nothing(parsed):
    none = parsed.drop("proved").selectExpr("*", "false as proved")
    assert pr.subsumers(none).count() == 0 and pr.equivalents(none).count() == 0 and pr.conclusions(none).count() == 0
