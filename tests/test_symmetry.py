"""Motifs of symmetry on statements known by hand; families and citations against plain versions."""

import hashlib
import math
import random

import pytest

from stratia.functions import symmetry as fs
from stratia.functions import terms
from stratia.operators import symmetry as sy

V = "x-stmt-v1;"


def const(name):
    return f"c({len(name)}:{name},0)"


def app(f, *xs):
    for x in xs:
        f = f"a({f},{x})"
    return f


def eq(x, y):
    return app(const("Eq"), const("T"), x, y)


def all_(body, n=1):
    for _ in range(n):
        body = f"pd({const('T')},{body})"
    return body


f, g, h, norm = map(const, ("f", "g", "h", "norm"))
KNOWN = [
    ("norm (neg x) = norm x", all_(eq(app(norm, app(g, "b0")), app(norm, "b0"))), {"INV": (True, 1, "a1:g", "R<L", False)}),
    ("neg (neg x) = x", all_(eq(app(g, app(g, "b0")), "b0")), {"INV": (True, 1, "a1:g|a1:g", "R<L", True)}),
    ("x + zero = x", all_(eq(app(f, "b0", h), "b0")), {"INV": (True, 1, "a0:h|a1:f", "R<L", True)}),
    ("f x y = f (g x) (g y)", all_(eq(app(f, "b1", "b0"), app(f, app(g, "b1"), app(g, "b0"))), 2), {"INV": (True, 2, "a1:g", "L<R", False)}),
    ("f x y = f (g x) (h y)", all_(eq(app(f, "b1", "b0"), app(f, app(g, "b1"), app(h, "b0"))), 2), {"INV": (False, 2, "a1:g+a1:h", "L<R", False)}),
    ("f x y = f y x", all_(eq(app(f, "b1", "b0"), app(f, "b0", "b1")), 2), {"SWAP": (True, 2, None, "swap", False)}),
    ("f x x = zero", all_(eq(app(f, "b0", "b0"), h)), {"CONS": (True, 1, None, "L>R", False)}),
    ("zero = f x x", all_(eq(h, app(f, "b0", "b0"))), {}),
    ("p x gives p (g x)", all_(f"pd({app(f, 'b0')},{app(f, app(g, 'b1'))})"), {"INV_IMP": (True, 1, "a1:g", "L<R", False)}),
    ("r x y gives r y x", all_(f"pd({app(f, 'b1', 'b0')},{app(f, 'b1', 'b2')})", 2), {"SWAP_IMP": (True, 2, None, "swap", False)}),
    ("x = x", all_(eq("b0", "b0")), {}),
    ("f x = g x", all_(eq(app(f, "b0"), app(g, "b0"))), {}),
    ("implicit variables do not count", f"pi({const('T')},{eq(app(f, 'b0', 'b0'), h)})", {}),
    ("wrapping under a binder", eq(f"ld({const('T')},{app(g, 'b0')})", f"ld({const('T')},b0)"), {"INV": (True, 1, "a1:g", "R<L", False)}),
]


@pytest.mark.parametrize("name, stmt, want", KNOWN, ids=[k[0] for k in KNOWN])
def test_known_statements(name, stmt, want):
    got = fs.motifs(terms.parse(V + stmt))
    assert {m["motif"]: (m["strict"], m["variables"], m["context"], m["direction"], m["whole"]) for m in got} == want


def test_lowering_and_free_variables():
    t = terms.parse(V + f"a(b2,ld({const('T')},a(b0,b3)))")
    assert fs.free(t) == {2} and fs.lowered(t) == terms.parse(V + f"a(b1,ld({const('T')},a(b0,b2)))")
    assert fs.context(t, terms.parse(V + "b0")) is None


def test_rows_without_terms(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x-stmt-v1;("), ("c", V + KNOWN[0][1])], "name string, stmt string")
    assert [(r.name, r.motif) for r in sy.motifs(rows).collect()] == [("c", "INV")]
    assert sy.motifs(rows.limit(0)).count() == 0


def test_families_and_their_expected_spread(spark):
    rng = random.Random(3)
    decls = [(f"d{i}", f"m{min(int(rng.expovariate(0.4)), 8)}") for i in range(200)]
    found = [(n, "INV", "a1:g" if i % 3 else "a1:h", True) for i, (n, _) in enumerate(decls[:50])] + [(decls[60][0], "SWAP", None, True), (decls[61][0], "INV", "alone", True)]
    got = sy.families(spark.createDataFrame(found, "name string, motif string, context string, strict boolean"), spark.createDataFrame(decls, "name string, module string")).collect()
    assert {r.context for r in got} == {"a1:g", "a1:h"}
    module = dict(decls)
    for r in got:
        mine = [n for n, _, c, _ in found if c == r.context]
        sizes = [list(module.values()).count(m) for m in set(module.values())]
        want = sum(1 - math.comb(200 - s, len(mine)) / math.comb(200, len(mine)) for s in sizes)
        assert (r.n, r.first, r.modules) == (len(mine), min(mine), len({module[n] for n in mine})) and r.expected == pytest.approx(want, rel=1e-9)


def plain_draws(nodes, label, seed, draws):
    out = []
    for d in range(draws):
        taken = set()
        for bucket in {b for _, b, _ in nodes}:
            mine = [n for n, b, _ in nodes if b == bucket]
            k = sum(m for _, b, m in nodes if b == bucket)
            taken |= set(sorted(mine, key=lambda n: hashlib.md5(f"{seed}:{label}:{d}:{n}".encode()).hexdigest())[:k])
        out.append(taken)
    return out


def test_citations_equal_a_plain_version_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(sy, "BITS", 5)  # so that draws take more than one mask
    rng = random.Random(8)
    names = [f"n{i}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(150)] + [(n, "n0") for n in names] + [("n1", "elsewhere")]
    a, b = set(names[::4]), set(names[::5])
    table = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "name string")
    got = {(r.hops, r["null"]): r for r in sy.citations(spark.createDataFrame(edges, "src string, dst string"), table(names), table(a), table(b), draws=12).collect()}
    one = {(s, t) for s, t in edges if s != t and {s, t} <= set(names)}
    two = one | {(s, u) for s, t in one for t2, u in one if t == t2 and s != u}
    bucket = lambda v: 0 if v == 0 else min(12, int(math.log2(v)) + 1)
    out = {n: bucket(sum(s == n for s, _ in one)) for n in names}
    into = {n: bucket(sum(t == n for _, t in one)) for n in names}
    for null in ("uniform", "matched"):
        da, db = (plain_draws([(n, 0 if null == "uniform" else by[n], n in s) for n in names], label, sy.SEED, 12) for label, s, by in (("a", a, out), ("b", b, into)))
        for hops, graph in ((1, one), (2, two)):
            count = lambda x, y: sum(s in x and t in y for s, t in graph)  # noqa: E731, B023
            values = [count(x, y) for x, y in zip(da, db, strict=True)]
            mean = sum(values) / 12
            sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 12)
            r = got[hops, null]
            assert (r.observed, r.back) == (count(a, b), count(b, a)) and r.mean == pytest.approx(mean) and r.sd == pytest.approx(sd)
            assert r.p == pytest.approx((sum(v >= r.observed for v in values) + 1) / 13)


@pytest.mark.parametrize("near", [8.0, 1e-6, 1e9])
def test_draws_take_the_smallest_hashes_wherever_they_are_looked_for(spark, monkeypatch, near):
    """Only hashes near a draw's last one leave their task; where that one is elsewhere, more are kept."""
    monkeypatch.setattr(sy, "NEAR", near)
    kept, plain = [], sy.materialize
    monkeypatch.setattr(sy, "materialize", lambda df, name: (kept.append(plain(df, name)), kept[-1])[1])
    rng = random.Random(2)
    held = [(i, f"n{i}", rng.random() < 0.2, rng.random() < 0.5, rng.randrange(4), 12 * rng.randrange(2)) for i in range(2000)]
    got = {r["i"]: r for r in sy.drawn(spark.createDataFrame(held, "i long, name string, in_a boolean, in_b boolean, out int, in int"), 7, range(2, 5)).collect()}
    for label, column, member, degree in (("a", "source", 2, 4), ("b", "target", 3, 5)):
        for first, by in ((0, lambda r: 0), (sy.BITS + 1, lambda r, c=degree: r[c])):
            draws = plain_draws([(r[1], by(r), r[member]) for r in held], label, 7, 5)[2:]
            assert [{r[1] for r in held if got[r[0]][column] >> first + j & 1} for j in range(3)] == draws
    assert all((r["source"] >> sy.BITS & 1, r["source"] >> 2 * sy.BITS + 1 & 1, r["target"] >> sy.BITS & 1, r["target"] >> 2 * sy.BITS + 1 & 1) == (x[2], x[3], x[3], x[2]) for x in held for r in [got[x[0]]])
    sizes = kept[0].selectExpr("sum(size(open_a) + size(open_b)) n").first()["n"]
    assert (sizes > 0) == (len(kept) == 2) == (near >= 8) and (near > 8 or sizes < 2000 * 12 * 0.7)


def test_citations_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("a",), ("b",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("a", "a")], "src string, dst string")
    for r in sy.citations(edges, some, none, some, draws=4).collect():
        assert (r.observed, r.mean, r.z) == (0, 0, None)
    assert all(r.observed == 0 for r in sy.citations(edges, none, none, none, draws=4).collect())
