import random

import pytest
from pyspark.sql import functions as F

from stratia.functions.components import connected_components
from stratia.functions.numbering import numbered
from stratia.operators import claims, concepts, derivations, graph, intuition, records, selection, statements

EDGES = [("A", "B", "proof"), ("B", "A", "statement"), ("B", "C", "proof"), ("C", "outside", "proof"), ("D", "B", "statement"), ("D", "C", "proof")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, lens string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "source string")


def test_reachability_leaves_itself_out_and_keeps_outside_names(spark, edges):
    assert rows(graph.foundations(edges, names(spark, "A"))) == [("A", "B"), ("A", "C"), ("A", "outside")]
    assert rows(graph.foundations(edges, names(spark, "A"), "statement")) == []
    assert rows(graph.impact(edges, names(spark, "outside"), "proof")) == [("outside", x) for x in "ABCD"]


def test_impact_is_the_converse_of_foundations(spark, edges):
    every = names(spark, "A", "B", "C", "D", "outside")
    assert {(s, n) for s, n in rows(graph.foundations(edges, every))} == {(n, s) for s, n in rows(graph.impact(edges, every))}


def test_shortest_path_takes_the_first_names(spark):
    e = spark.createDataFrame([("a", x, "proof") for x in "cb"] + [(x, "z", "proof") for x in "bc"], "src string, dst string, lens string")
    got = graph.why(e, names(spark, "a", "z"), F.col("node") == "z").collect()
    assert sorted((r.source, r.path) for r in got) == [("a", ["a", "b", "z"]), ("z", ["z"])]


def test_walls_count_distinct_citers_of_declared_names(spark, edges):
    declared = spark.createDataFrame([(x,) for x in "ABCD"], "name string")
    assert [tuple(r) for r in graph.walls(edges, declared).collect()] == [("B", 2), ("C", 2), ("A", 1)]


def test_honesty_names_axioms_themselves(spark, edges):
    kinds = spark.createDataFrame([("C", "axiom"), ("A", "theorem")], "name string, kind string")
    assert rows(graph.honesty(edges, kinds)) == [("A",), ("B",), ("C",), ("D",)]
    assert rows(graph.honesty(edges, kinds, ("C",))) == []


def test_unknown_lens_is_named(edges):
    with pytest.raises(ValueError, match="statement, proof, both"):
        graph.through(edges, "all")


def test_theories(spark):
    df = spark.createDataFrame([("Mathlib.A.B",), ("Mathlib.A",), ("Core.X",)], "m string")
    assert rows(df.select(graph.theory_of(F.col("m")), graph.module_root(F.col("m")), graph.in_theory(F.col("m"), "Mathlib.A"))) == [("Core", "Core", False), ("Mathlib.A", "Mathlib", True), ("Mathlib.A", "Mathlib.A", True)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    got = dict(map(tuple, connected_components(e).collect()))
    assert all(got[i] == 0 for i in range(201)) and got[500] == 500 and got[601] == 600


def test_closure_and_its_ways_keep_the_best_warrant(spark):
    pairs = [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("5", "5"), ("5", "6")]
    edges = spark.createDataFrame(pairs + pairs[:1], "src string, dst string")
    reached = derivations.closure(edges)
    assert sorted(map(tuple, reached.collect())) == sorted([(x, y) for x in "123" for y in "1234"] + [("5", "5"), ("5", "6")])
    ways = derivations.closure_ways(edges, reached)
    assert ways.filter("rule = 'base'").count() == len(pairs)
    given = edges.distinct().select(derivations.fact("edge", "src", "dst").alias("fact"), F.when(F.col("dst") == "4", derivations.ASSERTED).otherwise(derivations.PROVED).alias("warrant"))
    found = dict(map(tuple, derivations.warrants(ways, given).collect()))
    assert found["reach,1,1"] == derivations.STRUCTURAL and found["reach,1,4"] == derivations.ASSERTED and found["edge,1,2"] == derivations.PROVED
    best = {r.fact: r.rule for r in derivations.explain(ways, derivations.warrants(ways, given)).collect()}
    assert best["reach,1,2"] == "base" and best["reach,1,3"] == "step"


def test_numbers_follow_the_order(spark):
    rows_ = [(f"k{i % 7}", i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows_, "k string, v long").repartition(5), "k", F.col("v").desc()).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.i)] == sorted(rows_, key=lambda r: (r[0], -r[1])) and sorted(r.i for r in got) == list(range(500))
    assert numbered(spark.createDataFrame([], "k string"), "k").count() == 0


def test_covers_equal_brute_force(spark):
    rng = random.Random(7)
    masks_ = {rng.getrandbits(7) for _ in range(14)}
    intents = {127}
    while True:
        more = intents | {i & m for i in intents for m in masks_}
        if more == intents:
            break
        intents = more
    part = lambda a, b: a & b == a and a != b
    want = {(a, b) for a in intents for b in intents if part(a, b) and not any(part(a, c) and part(c, b) for c in intents)}
    assert {tuple(r) for r in concepts.covers(spark.createDataFrame([(i,) for i in intents], "intent long")).collect()} == want


def test_masked_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    data = [(f"d{i}", rng.choice(["r", "q"]), [rng.choice("abc") for _ in range(3)]) for i in range(60)] + [("e1", "r", []), ("e2", "r", [])]
    parsed = spark.createDataFrame(data, "name string, rigid string, slots array<string>")
    want = set()
    for n, r, s in data:
        for m, q, t in data:
            edits = {(x, y) for x, y in zip(s, t, strict=False) if x != y}
            if n != m and r == q and len(s) == len(t) and len(edits) == 1:
                want.add((n, m, *edits.pop()))
    got = {(r.name, r.other, r.edits[0].s, r.edits[0].t) for r in statements.variants(parsed).collect()}
    assert got == want and statements.variants(parsed).count() == len(want)


def test_greedy_diversity_is_the_window_form(spark):
    scored = spark.createDataFrame([("d", m, f, i, b) for i, (m, f, b) in enumerate([("m0", "x", 0.9), ("m1", "x", 0.8), ("m2", "y", 0.7), ("m3", "x", 0.69), ("m4", "y", 0.7)])], "name string, method string, family string, i int, base double")
    left, taken, order = {r.method: r for r in scored.collect()}, {}, []
    while left:
        best = max(left.values(), key=lambda r: (round(r.base * intuition.FAMILY_PENALTY ** taken.get(r.family, 0), 12), -r.i))
        order.append(best.method)
        taken[best.family] = taken.get(best.family, 0) + 1
        del left[best.method]
    assert [r.method for r in intuition.diversify(scored, 9).orderBy("rank").collect()] == order


def test_closure_of_an_unmet_seed_is_everything(spark):
    objects = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],)], "tags array<string>")
    counted = concepts.masks(objects, ["a", "b", "c"])
    assert rows(concepts.closures(counted, [1, 2, 6], 3)) == [(1, 1, 2), (2, 3, 1), (6, 7, 0)]
    assert {r.intent for r in concepts.lattice(counted, 3).collect()} == {0, 1, 3, 4, 7}


def test_records_are_checked(spark):
    facts = spark.createDataFrame([(1, 0, "assertion", []), (2, 1, "derived", [1, 9]), (3, 3, "oracle", []), (3, 3, "oracle", []), (4, 2, "derived", [5]), (5, 3, "candidate", [])], "id long, warrant int, provenance string, inputs array<long>")
    assert {(r.id, r.rule) for r in records.fact_violations(facts).collect()} == {(1, "above-ceiling"), (2, "missing-input"), (3, "duplicate-id"), (4, "above-support")}


def test_statements_that_do_not_parse_are_left_out(spark):
    decls = spark.createDataFrame([(1, "good", "theorem", "M", "x-stmt-v1;a(c(1:f,0),n1)"), (2, "bad", "theorem", "M", "x-stmt-v1;a("), (3, "none", "theorem", "M", None)], "seq long, name string, kind string, module string, stmt string")
    parsed = statements.parse(decls)
    assert [r.name for r in parsed.collect()] == ["good"]
    assert [r.erased for r in statements.erased(parsed, "shape").collect()] == ["a(_,_)"]


def test_variants_count_distinct_replacements(spark):
    stmt = lambda a, b: f"x-stmt-v1;a(a(c(1:{a},0),c(1:{b},0)),c(1:{a},0))"
    decls = spark.createDataFrame([(1, "p", "theorem", "M", stmt("f", "x")), (2, "q", "theorem", "M", stmt("g", "x")), (3, "r", "theorem", "M", stmt("g", "y"))], "seq long, name string, kind string, module string, stmt string")
    parsed = statements.parse(decls)
    assert {(r.name, r.other) for r in statements.variants(parsed, 1).collect()} == {("p", "q"), ("q", "p"), ("q", "r"), ("r", "q")}
    assert {(r.other, r.n) for r in statements.variants(parsed, 2).filter("name = 'p'").collect()} == {("q", 1), ("r", 2)}


def test_exploration_equals_a_plain_beam_search(spark):
    from stratia.plans.methods import METHODS

    def fit(m, tags):
        return len(set(m["recognizes"]) & tags) / len(m["recognizes"])

    def breadth(tags):
        return sum(fit(m, tags) >= intuition.FITS for m in METHODS)

    def search(tags, depth=3, beam=4):
        nodes, front = {tags: ([], 1.0, 0)}, [tags]
        for level in range(depth):
            made = []
            for place, t in enumerate(front):
                for m in METHODS:
                    added = set(m["unlocks"]) - t
                    if fit(m, t) < 0.25 or not added:
                        continue
                    after, new = frozenset(t | added), len(added) / len(m["unlocks"])
                    gain = min(max(breadth(after) - breadth(t), 0) / 5, 1)
                    native = len(set(m["native"]) & t) / len(m["native"])
                    step = 0.44 + 0.18 * (1 - native) + 0.26 * new + 0.12 * gain if level == 0 else 0.66 + 0.2 * new + 0.14 * gain
                    made.append((nodes[t][1] * fit(m, t) * step * 0.94**level, m["family"], m["method"], place, after, [*nodes[t][0], m["method"]]))
            made.sort(key=lambda x: (-round(x[0], 12), *x[1:4]))
            chosen, used = [], {}
            while made and len(chosen) < beam:
                i = max(range(len(made)), key=lambda i: (round(made[i][0] * intuition.FAMILY_PENALTY ** used.get(made[i][1], 0), 12), -i))
                used[made[i][1]] = used.get(made[i][1], 0) + 1
                chosen.append(made.pop(i))
            for s, _, _, _, after, path in chosen:
                if after not in nodes or s > nodes[after][1]:
                    nodes[after] = (path, s, nodes[after][2] if after in nodes else level + 1)
            front = sorted(dict.fromkeys(c[4] for c in chosen), key=lambda t: -round(nodes[t][1], 12))[:beam]
        return {(">".join(p), ",".join(sorted(t)), d, round(s, 9)) for t, (p, s, d) in nodes.items()}

    starts = [["debtor", "africa"], ["buyer"], ["building", "america", "debtor"], []]
    objects = spark.createDataFrame([(str(i), t) for i, t in enumerate(starts)], "name string, tags array<string>")
    got = intuition.explore(objects, METHODS, beam=4).collect()
    for i, t in enumerate(starts):
        assert {(">".join(r.path), ",".join(r.tags), r.depth, round(r.score, 9)) for r in got if r.name == str(i)} == search(frozenset(t))


def test_selection_is_stable_and_keeps_the_bound(spark):
    rng = random.Random(11)
    pairs = {(f"l{rng.randrange(30)}", f"r{rng.randrange(6)}"): rng.randrange(8) / 4 for _ in range(140)}
    scored = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "left string, right string, score double")
    lefts = spark.createDataFrame([(f"l{i}",) for i in range(33)], "left string")
    free = {r.left: r for r in selection.select(scored, lefts).collect()}
    for cap in (1, 3):
        got = {r.left: r for r in selection.select(scored, lefts, cap).collect()}
        assert len(got) == 33
        taken = {}
        for r in got.values():
            if r.right is not None:
                taken.setdefault(r.right, []).append(r.left)
        assert all(len(x) <= cap for x in taken.values())
        for left, r in got.items():
            mine = [(b, s) for (a, b), s in pairs.items() if a == left]
            assert r.state == ("absent" if not mine else "selected" if r.right else "unmatched")
            assert (r.best == min(mine, key=lambda x: (-x[1], x[0]))[0]) if r.state == "unmatched" else r.best is None
            # No pair would rather have one another.
            for b, s in mine:
                if r.right is None or (-s, b) < (-r.score, r.right):
                    there = taken.get(b, [])
                    assert len(there) == cap and all((-pairs[x, b], x) < (-s, left) for x in there)
    assert all(r.right == min(((-s, b) for (a, b), s in pairs.items() if a == left), default=(0, None))[1] for left, r in free.items())
    assert selection.select(scored.limit(0), lefts, 1).filter("state = 'absent'").count() == 33


def test_verdicts_and_claims_with_nulls(spark):
    rows_ = spark.createDataFrame([("x-stmt-v1;n1", None), (None, "x"), ("x-stmt-v1;n1", "x-stmt-v1:sha256:zz"), ("no version", "x-stmt-v1:sha256:00")], "e string, f string")
    assert [r.v for r in rows_.select(claims.verdict(F.col("e"), F.col("f")).alias("v")).collect()] == [None, None, "malformed-freeze", "unknown-version"]
    made = spark.createDataFrame([(1, 7, None, None, None, None), (2, None, ["a"], "s", "formal", [1])], "claim long, relation long, args array<string>, scope string, evidence string, targets array<long>")
    schema = spark.createDataFrame([(7, ["a"], "required", ["formal"])], "relation long, arguments array<string>, scope_policy string, admissible array<string>")
    assert {(r.claim, r.rule) for r in claims.claim_violations(made, schema).collect()} == {(1, "wrong-arity"), (2, "unknown-relation")}
    lists = spark.createDataFrame([(1, [2, 3]), (2, None)], "id long, inputs array<long>")
    assert rows(claims.reference_violations(lists, "id", "inputs", lists, "id")) == [(1, 3)]
