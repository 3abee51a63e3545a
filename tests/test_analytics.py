"""Transfer, crossing, smallest sets and features against plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratia.operators import crossing as cr
from stratia.operators import features as fe
from stratia.operators import statements as st
from stratia.operators import subsets as su
from stratia.operators import transfer as tr

V = "x-stmt-v1;"


def const(name):
    return f"c({len(name)}:{name},0)"


def app(f, *xs):
    for x in xs:
        f = f"a({f},{x})"
    return f


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        a, b = rng.choice("ABCDE"), rng.choice(["p", "q", "r"])
        inner = app(const("f"), const(a), const(b)) if i % 3 else app(const("g"), const(a), const(a))
        rows.append((i, f"d{i:03}", "theorem", f"M{rng.randint(0, 7)}", V + app(const("Rel"), inner, f"n{rng.randint(0, 3)}")))
    return rows, st.parse(spark.createDataFrame(rows, "seq long, name string, kind string, module string, stmt string")).cache()


def plain_corpus(corpus):
    from stratia.functions import terms

    first = {}
    for _, name, _, module, stmt in corpus[0]:
        root = stmt[len(V) :]
        if root not in first or name < first[root][0]:
            first[root] = (name, module)
    return {name: (terms.rigid(terms.parse(V + root)), module) for root, (name, module) in first.items()}


def plain_pairs(reps):
    for x, y in itertools.permutations(reps, 2):
        (rx, sx), (ry, sy) = reps[x][0], reps[y][0]
        if rx == ry:
            edits = {(a, b) for a, b in zip(sx, sy, strict=True) if a != b}
            if len(edits) == 1:
                yield x, y, *edits.pop(), repr(rx)


def plain_draw(seen, *parts):
    total = sum(seen.values())
    at = unit(tr.SEED, *parts) % total
    for sym in sorted(seen):
        if at < seen[sym]:
            return sym
        at -= seen[sym]


def test_transfer_equals_a_plain_version(spark, corpus):
    theories = spark.createDataFrame([(r[1], r[3]) for r in corpus[0]], "name string, theory string")
    got = {r.least: r for r in tr.transfer(corpus[1], theories).collect()}
    reps = plain_corpus(corpus)
    half = {n: unit(tr.SEED, m) % 2 for n, (_, m) in reps.items()}
    learned, held = defaultdict(set), Counter()
    for x, y, a, b, rigid in plain_pairs(reps):
        if x < y and half[x] == half[y]:
            key = (min(a, b), max(a, b))
            if half[x]:
                held[key] += 1
            else:
                learned[key].add(rigid)
    seen = Counter(s for (_, slots), _ in reps.values() for s in slots)
    assert held and learned
    for k in tr.LEAST:
        known = {x for x, s in learned.items() if len(s) >= k}
        nulls = [sum((min(lo, d), max(lo, d)) in known for lo, hi in held for d in [plain_draw(seen, t, lo, hi)]) for t in range(tr.TRIALS)]
        r = got[k]
        assert (r.inventory, r.held, r.hits, r.held_pairs, r.hit_pairs) == (len(known), len(held), sum(x in known for x in held), sum(held.values()), sum(n for x, n in held.items() if x in known))
        assert r.null_mean == pytest.approx(sum(nulls) / len(nulls)) and r.null_most == max(nulls)


def test_transports_equal_a_plain_version(corpus):
    reps = plain_corpus(corpus)
    skeletons = defaultdict(set)
    for _, _, a, b, rigid in plain_pairs(reps):
        skeletons[a, b].add(rigid)
    inventory = {k for k, s in skeletons.items() if len(s) >= 2}
    assert inventory
    known = {(repr(r), tuple(s)): n for n, ((r, s), _) in sorted(reps.items(), reverse=True)}
    rewrite = lambda pairs: [(n, a, b, known.get((repr(r), tuple(b if s == a else s for s in slots)))) for n, ((r, slots), _) in reps.items() for a, b in pairs if a in slots and a != b]
    want = rewrite(inventory)
    assert sorted(map(str, (tuple(r) for r in tr.open_targets(corpus[1]).collect()))) == sorted(map(str, want))
    seen = Counter(s for (_, slots), _ in reps.values() for s in slots)
    control = rewrite({(a, plain_draw(seen, a, b)) for a, b in inventory if a < b})
    count = lambda rows: (len(rows), sum(r[3] is not None for r in rows), sum(r[3] is None for r in rows))
    assert {r.arm: (r.tried, r.hits, r.open) for r in tr.transports(corpus[1]).collect()} == {"inventory": count(want), "control": count(control)}


def test_transfer_of_nothing(spark, corpus):
    none = corpus[1].limit(0)
    assert {tuple(r)[1:] for r in tr.transfer(none, spark.createDataFrame([], "name string, theory string")).collect()} == {(0, 0, 0, 0, 0, 0.0, 0)}
    assert {(r.tried, r.hits, r.open) for r in tr.transports(none).collect()} == {(0, 0, 0)}


def test_stronger_members_equal_all_pairs(spark):
    above = {"a": {"b", "c", "d"}, "b": {"d"}, "c": {"d"}, "d": set()}
    rng = random.Random(3)
    asks = {f"n{i}": set(rng.sample("abcd", rng.randint(1, 2))) for i in range(80)}
    members = {n: f"k{rng.randint(0, 12)}" for n in asks} | {"lone": "k99", "bare": "k1"}
    asks["lone"] = {"a"}
    got = {r.name: r.weaker for r in cr.stronger(
        spark.createDataFrame(list(members.items()), "name string, canon string"),
        spark.createDataFrame([(n, c) for n, cs in asks.items() for c in cs] * 2, "name string, class string"),
        spark.createDataFrame([(c, x) for c, xs in above.items() for x in xs], "class string, above string"),
    ).collect()}
    want = {}
    for n, cs in asks.items():
        reach = set(cs).union(*(above[c] for c in cs))
        weaker = [sorted(asks[o]) for o in asks if members[o] == members[n] and asks[o] != cs and asks[o] <= reach]
        if weaker:
            want[n] = min(weaker)
    assert got == want and want


def test_crossing_and_its_control(spark):
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    left, right, pool = {f"n{i}" for i in range(0, 60, 2)}, {f"n{i}" for i in range(0, 60, 3)}, {f"n{i}" for i in range(50)}
    got = {r.name: r.flagged for r in cr.crossed(table(left), table([*right, *right])).collect()}
    assert got == {n: "both" if n in left & right else "left" if n in left else "right" for n in left | right}
    r = cr.control(table(left), table(right), table(pool)).first()
    drawn = {sorted(pool)[unit(cr.SEED, i) % 50] for i in range(len(left & pool))}
    assert (r.eligible, r.right, r.left, r.both, r.sham) == (50, len(right & pool), len(left & pool), len(left & right & pool), len(drawn & right))
    assert r.base == pytest.approx(len(right & pool) / 50) and r.lifted == pytest.approx(r.both / r.left)
    assert tuple(cr.control(table([]), table([]), table([])).first()) == (0, 0, 0, 0, None, None, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_minimal_sets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    universe = "uvwxyz"
    upset = {c: {c, *rng.sample(universe, rng.randint(0, 3))} for c in "abcde"}
    goals = {f"g{i}": (set(rng.sample("abcde", rng.randint(0, 5))), set(rng.sample(universe, rng.randint(0, 4)))) for i in range(30)}
    items = spark.createDataFrame([(g, c) for g, (cs, _) in goals.items() for c in cs] * 2 + [(None, "a")], "goal string, item string")
    needs = spark.createDataFrame([(g, n) for g, (_, ns) in goals.items() for n in ns], "goal string, need string")
    up = spark.createDataFrame([(c, x) for c, xs in upset.items() for x in xs], "class string, at string")
    tried = []
    test = su.covers(needs, up)
    found, cut = su.minimal_sets(spark.createDataFrame([(g,) for g in goals], "goal string"), items, lambda s: tried.append(s.count()) or test(s), most=3)
    want, most = set(), 0
    for g, (cs, ns) in goals.items():
        hits = []
        for k in range(4):
            for s in itertools.combinations(sorted(cs), k):
                most += 1
                if ns <= set().union(*(upset[c] for c in s)) and not any(set(h) <= set(s) for h in hits):
                    hits.append(s)
        want |= {(g, h) for h in hits}
    assert {(r.goal, tuple(r["items"])) for r in found.collect()} == want
    assert sum(tried) < most
    left = {r.goal for r in cut.collect()}
    assert left <= {g for g, (cs, _) in goals.items() if len(cs) > 3}


def test_features_of_known_declarations(spark):
    decls = spark.createDataFrame([("a", "theorem", "X", V + f"pi(s(+(0)),pt({const('R')},pd(b1,{const('P')})))"), ("b", "recursor", "X", None), ("c", "def", "Y", "x-stmt-v1;("), ("é", "constructor", "Y", V + const("é"))], "name string, kind string, space string, stmt string")
    uses = spark.createDataFrame([("a", "b", "proof"), ("a", "c", "proof"), ("a", "c", "proof"), ("a", "gone", "proof"), ("a", "c", "statement"), ("b", "a", "proof"), ("x", "a", "statement")], "name string, used string, lens string")
    got = {r.name: r.asDict() for r in fe.features(decls, uses).collect()}
    a = got["a"]
    assert (a["proof_size"], a["stmt_size"], a["in_degree"], a["n_binders"], a["is_theorem"]) == (4, 1, 2, 3, 1)
    assert (a["proof_frac_recursor"], a["proof_frac_def"], a["proof_frac_struct"], a["proof_over_stmt"], a["foreign_proof"]) == (0.25, 0.5, 0.25, 4, 0.75)
    assert (a["frac_inst_binders"], a["frac_impl_binders"]) == (1 / 3, 1 / 3)
    assert got["b"]["proof_frac_theorem"] == 1 and got["b"]["enc_len"] == 0 and got["c"]["n_binders"] == 0 and got["é"]["enc_len"] == len((V + const("é")).encode())


def test_baseline_learns_and_is_judged_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", *([float(rng.random()) for _ in fe.COLUMNS])) for i in range(400)]
    table = spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} double" for c in fe.COLUMNS))
    labels = table.select("name", (F.col("enc_len") + F.col("in_degree") > 1).cast("int").alias("label"))
    scored = fe.baseline(table, labels)
    judged = {r.family: r for r in fe.judged({"fitted": scored.filter("held_out")}, labels).collect()}
    assert judged["fitted"].auc > 0.97 and 60 < judged["fitted"].positives + judged["fitted"].negatives < 140
