"""Dimensions: rows of statements, and exact elimination against a plain version over fractions."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stratia.functions import dimensions as fd
from stratia.functions import terms
from stratia.operators import dimensions as dim

V = "x-stmt-v1;"


def const(name):
    return f"c({len(name)}:{name},0)"


def app(f, *xs):
    for x in xs:
        f = f"a({f},{x})"
    return f


def op(name, *xs):
    return app(const(name), *xs)


def eq(x, y):
    return op("Eq", const("R"), x, y)


def rows(body, **more):
    return [{k: v for k, v in r.items()} for r in fd.Statement(terms.parse(V + body), **more).rows]


A, B, C = const("A"), const("B"), const("C")
g = lambda name: (False, f"{name}()")


def test_products_quotients_powers_and_casts():
    assert rows(eq(op("HMul.hMul", A, B), op("HDiv.hDiv", C, op("HPow.hPow", A, "n2")))) == [{g("A"): 3, g("B"): 1, g("C"): -1}]
    assert rows(eq(op("Neg.neg", A), op("Inv.inv", B))) == [{g("A"): 1, g("B"): 1}]
    assert rows(eq(op("Nat.cast", const("R"), A), B)) == [{g("A"): 1, g("B"): -1}]
    assert rows(eq(A, A)) == []


def test_sums_say_that_both_sides_are_alike_wherever_they_stand():
    assert rows(eq(op("HAdd.hAdd", A, B), C)) == [{g("A"): 1, g("B"): -1}, {g("A"): 1, g("C"): -1}]
    assert rows(f"pd({eq(A, B)},{op('P', op('HSub.hSub', B, C))})") == [{g("A"): 1, g("B"): -1}, {g("B"): 1, g("C"): -1}]


def test_bound_variables_and_unknown_terms_are_local():
    assert rows(f"pd({const('R')},pd({const('R')},{eq('b1', op('HMul.hMul', 'b0', A))}))") == [{(True, "b0"): 1, (True, "b1"): -1, g("A"): -1}]
    assert rows(eq(A, f"ld({const('R')},b0)")) == [{g("A"): 1, (True, "f1"): -1}]
    assert rows(eq(op("HPow.hPow", A, "b0"), B)) == [{(False, "HPow.hPow(c(1:A,0),_)"): 1, g("B"): -1}]
    assert rows(f"pd({const('R')},{eq(op('v', 'b0', A), B)})") == [{(False, "v(_,c(1:A,0))"): 1, g("B"): -1}]
    assert rows(f"pd({const('R')},{eq(op('v', 'b0', A), B)})", keying="coarse") == [{(False, "v"): 1, (False, "B"): -1}]


def test_numbers_have_no_dimension_but_units_have_any():
    assert rows(eq(op("HMul.hMul", "n3", A), B)) == [{g("A"): 1, g("B"): -1}]
    assert rows(eq(op("OfNat.ofNat", const("R"), "n0", const("i")), B)) == [{(True, "f1"): 1, g("B"): -1}]
    assert rows(eq("n3", B), literals="free") == [{(True, "f1"): 1, g("B"): -1}]
    with pytest.raises(ValueError, match="keying"):
        rows(eq(A, B), keying="odd")


def test_locals_go_inside_a_statement():
    x = {(True, "b0"): Fraction(2), g("A"): Fraction(1)}
    y = {(True, "b0"): Fraction(3), (True, "b1"): Fraction(1), g("B"): Fraction(1)}
    z = {(True, "b1"): Fraction(1), g("C"): Fraction(1)}
    # b0 = -A/2, b1 = -C: 3 b0 + b1 + B = 0 gives B - 3/2 A - C = 0
    (left,) = fd.without_locals([x, y, z])
    assert fd.primitive(left) == {"A()": 3, "B()": -2, "C()": 2}


def plain(rows):
    """Greedy verdicts in order, and the reduced form, over fractions."""
    pivots, verdicts = {}, []
    for row in rows:
        row = {k: Fraction(v) for k, v in row.items()}
        while hit := next((c for c in sorted(row) if c in pivots), None):
            row = fd.plus(row, pivots[hit], -row[hit])
        verdicts.append("independent" if row else "implied")
        if row:
            lead = min(row)
            row = {k: v / row[lead] for k, v in row.items()}
            pivots = {c: fd.plus(r, row, -r[lead]) if lead in r else r for c, r in pivots.items()}
            pivots[lead] = row
    return verdicts, {(c, k): v for c, r in pivots.items() for k, v in r.items()}


def system(spark, rows):
    data = [(i // 3, f"d{i // 3}", i % 3, ";".join(f"{k}^{v}" for k, v in sorted(r.items())), [(k, Decimal(v)) for k, v in sorted(r.items())]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, name string, row int, form string, entries array<struct<atom: string, v: decimal(38,0)>>")


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 5), (3, 2000)])
def test_elimination_equals_the_plain_version(spark, monkeypatch, seed, block):
    """By rounds of joins alone, by blocks of 5 rows first, and in one block."""
    monkeypatch.setattr(dim, "BLOCK", block)
    rng = random.Random(seed)
    atoms = [f"q{i}" for i in range(9)]
    made = [{a: v for a in rng.sample(atoms, rng.randint(1, 4)) if (v := rng.choice([-3, -2, -1, 1, 2, 5]))} for _ in range(14)]
    made += [made[2], made[0], {k: v for k, v in made[5].items()}]
    verdicts, reduced = dim.solve(system(spark, made))
    want, form = plain(made)
    got = {(r.seq, r.row): r.verdict for r in verdicts.collect()}
    assert [got[i // 3, i % 3] for i in range(len(made))] == want
    assert {(r.pivot, r.atom): Fraction(int(r.num), int(r.den)) for r in reduced.collect()} == form
    asked = [*made[:3], {"q0": 1, "q8": 7}, {"new": 1}, {k: -2 * v for k, v in made[1].items()}]
    said = {(r.seq, r.row): r.implied for r in dim.implied(system(spark, asked), reduced).collect()}
    dependent = [plain([*made, a])[0][-1] == "implied" for a in asked]
    assert [said[i // 3, i % 3] for i in range(len(asked))] == dependent


def test_a_chain_settles_in_few_rounds_backwards_and_copies_are_one_row(spark, monkeypatch):
    chain = [{f"q{i:02}": 1, f"q{i + 1:02}": -2} for i in range(16)]
    monkeypatch.setattr(dim, "BLOCK", 1)
    added = []
    keep = dim._Rows.add
    monkeypatch.setattr(dim._Rows, "add", lambda self, e: added.append(1) or keep(self, e))
    verdicts, reduced = dim.solve(system(spark, chain + [chain[0]] * 60))
    assert verdicts.filter("verdict = 'independent'").count() == 16
    found = {(r.pivot, r.atom): int(r.num) for r in reduced.collect()}
    assert found["q00", "q16"] == -(2**16) and len(added) <= 1 + 5  # the rows themselves, and log2 of the chain's length


def test_values_that_do_not_fit_raise_and_odd_rows_are_nothing(spark, monkeypatch):
    monkeypatch.setattr(dim, "BLOCK", 1)
    big = 10**18 + 9
    with pytest.raises(Exception, match="(?i)digits|overflow|out of range"):
        dim.solve(system(spark, [{"a": big, "b": 3}, {"a": big + 2, "c": 7}, {"b": big + 4, "c": big + 6}, {"b": big + 10, "c": big + 16}]))[1].collect()
    odd = spark.createDataFrame([(1, "n", None), (2, "m", "x-stmt-v1;q("), (3, "e", V + const("A"))], "seq long, name string, stmt string")
    assert dim.equations(odd).count() == 0
    verdicts, reduced = dim.solve(dim.constraints(odd))
    assert verdicts.count() == 0 and reduced.count() == 0


def test_gcd_and_lcm(spark):
    whole = lambda n: F.lit(str(n)).cast(dim.WHOLE)
    row = spark.range(1).select(dim.gcd(whole(-12), whole(18)).alias("a"), dim.lcm(whole(4), whole(6)).alias("b"), dim.gcd(whole(0), whole(7)).alias("c"), dim.gcd(whole(10**37), whole(6 * 10**36)).alias("d"), dim.fold(F.array(*map(whole, (4, 6, 10))), dim.lcm).alias("e")).first()
    assert [int(x) for x in row] == [6, 12, 7, 2 * 10**36, 60]
