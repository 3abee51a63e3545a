"""Best selections against brute force, in tasks and dealt out, and the states of left sides."""

import random

import numpy as np
import pytest

from stratia.functions import assignment
from stratia.operators import selection


def brute(rows, cap):
    """(most rows, best total) over all selections."""
    lefts = sorted({left for left, _, _ in rows})
    by = {left: [(right, s) for a, right, s in rows if a == left] for left in lefts}
    known = {}

    def best(i, used):
        if i == len(lefts):
            return 0, 0
        key = i, tuple(sorted(used.items()))
        if key not in known:
            out = best(i + 1, used)
            for right, s in by[lefts[i]]:
                if used.get(right, 0) < cap:
                    n, total = best(i + 1, used | {right: used.get(right, 0) + 1})
                    out = max(out, (n + 1, total + s))
            known[key] = out
        return known[key]

    return best(0, {})


def table(spark, rows):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], "left string, right string, score double")


def run(spark, rows, cap=1, **more):
    lefts = spark.createDataFrame(sorted({(a,) for a, _, _ in rows}), "left string")
    return {r.left: r for r in selection.best_selection(table(spark, rows), lefts, cap, **more).collect()}


CONTESTED = [("a", "x", 0.90), ("a", "p", 0.50), ("b", "x", 0.80), ("b", "q", 0.40), ("c", "x", 0.70), ("c", "r", 0.30)]


def value(found):
    held = [r for r in found.values() if r.state == "selected"]
    return len(held), sum(r.score for r in held)


@pytest.mark.parametrize("seed, cap", [(1, 1), (2, 2)])
def test_most_rows_then_best_score_equal_brute_force(spark, seed, cap):
    """Several connected parts, some of equal scores."""
    rng = random.Random(seed)
    rows, want = [], (0, 0.0)
    for part in range(5):
        n, m = 6, 4
        one = [(f"{part}l{i}", f"{part}r{j}", rng.choice([1, 5, 9, 7.25, 0.0])) for i in range(n) for j in range(m) if rng.random() < 0.5]
        rows += one
        got = brute(one, cap)
        want = (want[0] + got[0], want[1] + got[1])
    found = run(spark, rows + rows[:3], cap)
    assert value(found) == pytest.approx(want)
    rights = [r.right for r in found.values() if r.right]
    assert all(rights.count(x) <= cap for x in rights)


def test_parts_that_no_task_holds_are_auctioned_in_blocks(spark, monkeypatch):
    """Small scores, as each fall of eps takes rounds of joins."""
    monkeypatch.setattr(selection, "MOST_CHOICES", 6)
    monkeypatch.setattr(selection, "SCALE", 1)
    rows = [("a", "x", 3), ("b", "x", 3), ("b", "y", 1), ("c", "y", 2), ("alone", "z", 1)]
    assert value(run(spark, rows)) == (3, 3 + 2 + 1)


def test_known_selections(spark):
    assert value(run(spark, CONTESTED)) == pytest.approx((3, 0.90 + 0.40 + 0.30))
    assert value(run(spark, CONTESTED, 2)) == pytest.approx((3, 0.90 + 0.80 + 0.30))
    coverage = run(spark, [("a", "x", 0.95), ("b", "x", 0.94), ("b", "y", 0.10)])
    assert (coverage["a"].right, coverage["b"].right) == ("x", "y")
    lost = run(spark, [("a", "x", 0.90), ("c", "x", 0.70)])
    assert (lost["c"].state, lost["c"].best, lost["a"].state) == ("unmatched", "x", "selected")


def test_all_states_of_left_sides(spark):
    rows = [("won", "x", 0.9), ("lost", "x", 0.8), ("low", "y", 0.1), ("low", "z", 0.2), ("refuted", "w", 0.9), (None, "x", 1.0), ("won", None, 1.0)]
    lefts = spark.createDataFrame([(x,) for x in ("won", "lost", "low", "refuted", "off", "none")], "left string")
    refuted = spark.createDataFrame([("refuted", "w")], "left string, right string")
    off = spark.createDataFrame([("off",), ("won",)], "left string")
    scored = spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], "left string, right string, score double")
    got = {r.left: (r.state, r.right, r.best) for r in selection.best_selection(scored, lefts, 1, 0.3, refuted, off).collect()}
    assert got == {"won": ("selected", "x", None), "lost": ("unmatched", None, "x"), "low": ("low-ranked", None, "z"), "refuted": ("contradicted", None, "w"), "off": ("unsupported", None, None), "none": ("absent", None, None)}


def test_nothing_to_select(spark):
    none = table(spark, [])
    assert selection.best_selection(none, none.select("left")).count() == 0


def test_prices_prove_the_assignment():
    rng = np.random.default_rng(5)
    n = 60
    benefit = rng.integers(0, 50, (n, n)) * (n + 1)
    start, objects, flat = np.arange(0, n * n + 1, n), np.tile(np.arange(n), n), benefit.ravel()
    held, price = assignment.solve(start, objects, flat, n)
    assert sorted(held) == list(range(n)) and 0 <= assignment.gap(start, objects, flat, held, price) <= n
    worse = np.roll(held, 1)
    assert assignment.gap(start, objects, flat, worse, price) > n


def test_scores_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        selection.best_selection(table(spark, [("a", "x", 1e13), ("b", "x", 1.0)]), table(spark, [("a", "x", 0.0)]).select("left"))


@pytest.mark.parametrize("cap", [1, 2])
def test_many_left_sides_of_few_right_ones_make_few_choices(spark, monkeypatch, cap):
    """Two parts, one of two right sides and 200 left ones, and the best totals of both."""
    seen, plain = [], selection._choices
    monkeypatch.setattr(selection, "_choices", lambda rows, n: (seen.append(sorted(map(tuple, rows.select("part", "right").collect()))), plain(rows, n))[1])
    rows = [(f"l{i:03}", r, (i * k) % 211 / 4) for i in range(200) for r, k in (("x", 7), ("y", 11))] + [("m", "z", 2.0), ("n", "z", 3.0)]
    assert value(run(spark, rows, cap)) == pytest.approx(tuple(a + b for a, b in zip(top_two(rows, cap), (min(cap, 2), 3.0 + 2.0 * (cap > 1)), strict=True)))
    assert len(seen[0]) <= 2 * 2 * cap + cap and len(set(p for p, _ in seen[0])) == 2


def top_two(rows, cap):
    """(rows, total) of the best selection for x and y, by trying all of the best few of either."""
    best = [sorted((r for r in rows if r[1] == side), key=lambda r: -r[2])[: 4 * cap] for side in "xy"]
    return brute(best[0] + best[1], cap)


def test_rounds_of_proposals_read_what_no_right_side_would_turn_away(spark, monkeypatch):
    """200 left sides want two right ones that take one each: after the first round few candidates are left."""
    seen, plain = [], selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, name: (lambda out: (seen.append((name, out.count())), out)[1])(plain(df, name)))
    rows = [(f"l{i:03}", r, (i * k) % 211) for i in range(200) for r, k in (("x", 7), ("y", 11))]
    found = selection.select(table(spark, rows), table(spark, rows).select("left"), 1).filter("right is not null")
    score = {(a, b): s for a, b, s in rows}
    got = {r.right: r.left for r in found.collect()}
    assert len(got) == 2 and max(n for name, n in seen if name == "candidates") <= 20
    for (a, b), s in score.items():  # no pair would both rather have one another
        mine = next((r for r, left in got.items() if left == a), None)
        assert not ((mine is None or (-s, b) < (-score[a, mine], mine)) and (-s, a) < (-score[got[b], b], got[b]))
