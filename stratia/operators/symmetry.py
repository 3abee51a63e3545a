"""Motifs of symmetry over a corpus, families of them, and whether one motif's declarations cite another's.

Defined cases: statements that are null or no terms have no motif; edges to names outside the universe and loops do not
count; a set without members has nothing observed and a null of zeros, whose z is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratia.functions import digests, packed, symmetry, terms
from stratia.functions.numbering import numbered
from stratia.session import materialize

SEED, DRAWS = 7, 20
#: Draws that one mask holds: their bits of the uniform null from 0, of the matched one from BITS + 1; the bit after each is for
#: the sets themselves.
BITS = 30
#: Standard deviations on either side of where a draw's last hash is expected, within which hashes are put in order.
NEAR = 8.0
HITS = "name string, motif string, strict boolean, variables int, context string, shape string, direction string, head string, arity int, whole boolean"


def motifs(decls: DataFrame) -> DataFrame:
    """(name, motif, strict, variables, context, shape, direction, head, arity, whole) of each statement's motifs."""
    kinds = [pa.string(), pa.bool_(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1 << 12)
        def read(stmt: str) -> list:
            try:
                return symmetry.motifs(terms.parse(stmt))
            except terms.TermError:
                return []

        for b in batches:
            names, rows = [], []
            for name, stmt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = read(stmt) if stmt is not None else []
                names += [name] * len(found)
                rows += found
            columns = [pa.array([r[f] for r in rows], t) for f, t in zip(symmetry.FIELDS, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["name", *symmetry.FIELDS])

    return decls.select("name", "stmt").mapInArrow(run, HITS)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by eight so that it is good to about 1e-12 of its value."""
    y = n.cast("double") + 9
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for k in range(1, 9):
        series = series - F.log(n.cast("double") + k)
    return series


def families(found: DataFrame, decls: DataFrame, least: int = 2) -> DataFrame:
    """(motif, context, n, first, modules, expected): declarations that share a motif and what it wraps around.

    modules: how many modules they lie in; expected: how many as many declarations drawn at random from decls would. Modules
    enter as a histogram of their sizes, of which N declarations have at most sqrt(2 N) different ones.
    """
    rows = found.filter("context is not null").join(decls.select("name", "module"), "name")
    kept = rows.groupBy("motif", "context").agg(F.countDistinct("name").alias("n"), F.min("name").alias("first"), F.countDistinct("module").alias("modules")).filter(F.col("n") >= least)
    sizes = decls.groupBy("module").agg(F.count("*").alias("s")).groupBy("s").agg(F.count("*").alias("c")).orderBy("s").collect()
    total = sum(r["s"] * r["c"] for r in sizes)
    if not total:
        return kept.withColumn("expected", F.lit(0.0))
    histogram = F.array(*(F.struct(F.lit(float(r["s"])).alias("s"), F.lit(float(r["c"])).alias("c")) for r in sizes))

    def met(e: Column) -> Column:
        """Modules of a size, times the chance that none of their declarations stays undrawn."""
        rest = F.lit(float(total)) - e["s"] - F.col("n")
        none = F.exp(log_factorial(F.lit(float(total)) - e["s"]) - log_factorial(F.greatest(rest, F.lit(0.0))) - log_factorial(F.lit(float(total))) + log_factorial(F.lit(float(total)) - F.col("n")))
        return e["c"] * F.when(rest < 0, F.lit(1.0)).otherwise(1 - none)

    return kept.withColumn("expected", F.aggregate(histogram, F.lit(0.0), lambda s, e: s + met(e)))


def degree_bucket(n: Column) -> Column:
    """0 for none, then one more than the whole part of log2, 12 at most."""
    return F.when(n == 0, 0).otherwise(F.least(F.lit(12), F.length(F.bin(n)))).cast("int")


MOST = (1 << 64) - 1


def _window(n: int, k: int, near: float) -> tuple[int, int]:
    """Of n hashes by their first 64 bits: those below the first number are among the k smallest, those beyond the second are not, as far as drawn() finds."""
    if k in (0, n):
        return (0, 0) if k == 0 else (MOST, MOST)
    wide = near * (math.sqrt(k / n * (1 - k / n) / n) + 4 / n)
    at = lambda x: min(max(int(x * 2**64), 0), MOST)
    return at(k / n - wide), at(k / n + wide)


MEMBER = ("in_a", "in_b", "out", "in")
HASHED = "i long, in_a boolean, in_b boolean, out int, in int, " + ", ".join(f"sure_{x} long, open_{x} array<struct<degree: int, j: int, h: string>>" for x in "ab")


def _hashes(ends: dict[tuple[str, int], tuple[int, int]], seed: int, draws: range):
    """Of (i, name, in_a, in_b, out, in), by side, in which draws a node surely is, and its hashes for which that is open; ends: windows by side and degree."""
    kept = pa.list_(pa.struct([("degree", pa.int32()), ("j", pa.int32()), ("h", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, n = [b["i"], *(b[c] for c in MEMBER)], b.num_rows
            for label, side in (("a", "out"), ("b", "in")):
                heads = digests.md5_heads([f"{seed}:{label}:{d}:".encode() for d in draws], b["name"])
                degree, mask, found = b[side].to_numpy(), np.zeros(n, np.int64), [[] for _ in range(n)]
                for null, first in ((-1, 0), (degree, BITS + 1)):
                    of = np.broadcast_to(null, n)
                    low, high = (np.array([ends[label, i][k] for i in of.tolist()], np.uint64) for k in (0, 1))
                    mask |= ((heads < low) << np.arange(first, first + len(draws))[:, None]).sum(0)
                    for j, row in zip(*np.nonzero((heads >= low) & (heads <= high)), strict=True):
                        h = hashlib.md5(f"{seed}:{label}:{draws[j]}:{b['name'][int(row)].as_py()}".encode()).hexdigest()
                        found[row].append({"degree": int(of[row]), "j": int(j), "h": h})
                columns += [pa.array(mask, pa.int64()), pa.array(found, kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *MEMBER, "sure_a", "open_a", "sure_b", "open_b"])

    return run


def _by_place(values: dict[tuple[int, int], object], at: Column | None = None) -> Column:
    """What the table has for columns degree and j (of `at`), null where it has nothing."""
    if not values:
        return F.lit(None)
    degree, j = (F.col(c) if at is None else at[c] for c in ("degree", "j"))
    return F.element_at(F.create_map(*(F.lit(x) for (i, k), v in values.items() for x in (100 * i + k, v))), 100 * degree + j)


def _by_bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bit, n): how many masks of a key have a bit."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        key, bits = b["key"].to_numpy(), packed.bits(b["mask"].to_numpy())
        for k in np.unique(key):
            sums[int(k)] = sums.get(int(k), 0) + bits[key == k].sum(0, dtype=np.int64)
    rows = [(k, i, n) for k, ns in sums.items() for i, n in enumerate(ns.tolist()) if n]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["key", "bit", "n"])


def bit_sums(rows: DataFrame) -> dict[tuple[int, int], int]:
    """How many rows (key, mask) of a key have a bit, by key and bit; there are few keys."""
    found = rows.select(F.col("key").cast("int").alias("key"), "mask").mapInArrow(_by_bit, "key int, bit int, n long")
    return {(r["key"], r["bit"]): r["n"] for r in found.groupBy("key", "bit").agg(F.sum("n").alias("n")).collect()}


def drawn(held: DataFrame, seed: int, draws: range) -> DataFrame:
    """(i, source, target): masks of the draws that take a node, as one of a and as one of b, and of whether it is one itself.

    held: (i, name, in_a, in_b, out, in). Each draw takes as many nodes of a bucket as it has members, those with the
    smallest hashes of seed, side, draw and name; the uniform null is one bucket of all degrees. Hashes are spread evenly,
    so that only those near the place where the last one is expected are kept and put in order; what lies below is counted,
    which tells whether the last one is among them. If not, more are kept. There are 13 buckets of degrees.
    """
    sides = [("a", "in_a", "out"), ("b", "in_b", "in")]
    sizes = {label: {r[degree]: (r["n"], r["k"]) for r in held.groupBy(degree).agg(F.count("*").alias("n"), F.count_if(member).alias("k")).collect()} for label, member, degree in sides}
    whole = {label: tuple(map(sum, zip(*sizes[label].values(), strict=True))) or (0, 0) for label, *_ in sides}
    near = NEAR
    while True:
        ends = {(label, -1): _window(*whole[label], near) for label, *_ in sides} | {(label, i): _window(*v, near) for label, *_ in sides for i, v in sizes[label].items()}
        hashed = materialize(held.select("i", "name", *MEMBER).mapInArrow(_hashes(ends, seed, draws), HASHED), "draws")
        # The last hash of each draw, by degree (-1 for all) and draw: of those that are kept the one whose place is left.
        last, fits = {}, True
        for label, _, degree in sides:
            below = bit_sums(hashed.select(F.col(degree).alias("key"), F.col(f"sure_{label}").alias("mask")))
            rest = {(-1, j): whole[label][1] - sum(below.get((i, j), 0) for i in sizes[label]) for j in range(len(draws))}
            rest |= {(i, j): k - below.get((i, j + BITS + 1), 0) for i, (_, k) in sizes[label].items() for j in range(len(draws))}
            ranked = hashed.select(F.inline(f"open_{label}")).withColumn("place", F.row_number().over(Window.partitionBy("degree", "j").orderBy("h")))
            last[label] = {(r["degree"], r["j"]): r["h"] for r in ranked.filter(F.col("place") == _by_place(rest)).collect()}
            fits = fits and all(k == 0 or at in last[label] for at, k in rest.items())
        if fits:
            break
        near *= 16
    out = {}
    for label, *_ in sides:
        taken = lambda x: F.coalesce(x["h"] <= _by_place(last[label], x), F.lit(False))  # noqa: E731, B023
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["j"] + F.when(x["degree"] < 0, 0).otherwise(BITS + 1))
        out[label] = F.aggregate(f"open_{label}", F.col(f"sure_{label}"), lambda s, x: F.when(taken(x), s.bitwiseOR(bit(x))).otherwise(s))  # noqa: B023
    flag = lambda c, by: F.when(F.col(c), F.lit(1 << by)).otherwise(0)
    own = lambda c, d: flag(c, BITS).bitwiseOR(flag(d, 2 * BITS + 1))
    return materialize(hashed.select("i", out["a"].bitwiseOR(own("in_a", "in_b")).alias("source"), out["b"].bitwiseOR(own("in_b", "in_a")).alias("target")), "draws")


#: What a mask at a node says: of one that cites it, of one that it cites, of itself. The two highest bits hold it.
CITING, CITED, ITSELF = range(3)


def _at_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bit, n) over rows (node, mask) sorted by node: 1: edges, 2: paths of two steps, with a bit at both ends."""
    total = {1: np.zeros(64, np.int64), 2: np.zeros(64, np.int64)}

    def add(sums: np.ndarray) -> None:
        total[1] += (sums[CITING] * sums[ITSELF]).sum(0)
        total[2] += (sums[CITING] * sums[CITED]).sum(0)

    held, before = np.zeros((3, 1, 64), np.int64), None
    for b in batches:
        if not b.num_rows:
            continue
        node, mask = b["node"].to_numpy(), b["mask"].to_numpy()
        kind, bits = mask >> 62 & 3, packed.bits(mask & (1 << 62) - 1)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sums = np.stack([np.add.reduceat(bits * (kind == k)[:, None], first, axis=0, dtype=np.int64) for k in range(3)])
        if node[0] == before:
            sums[:, :1] += held
        else:
            add(held)
        add(sums[:, :-1])
        held, before = sums[:, -1:], node[-1]
    add(held)
    rows = [(k, i, n) for k, ns in total.items() for i, n in enumerate(ns.tolist()) if n]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["key", "bit", "n"])


def citations(edges: DataFrame, universe: DataFrame, a: DataFrame, b: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(hops, null, observed, back, mean, sd, z, p): do declarations of set a cite those of b more than drawn sets would?

    edges: (src, dst); universe, a, b: (name). Hops 1 counts edges, 2 pairs within two steps. The uniform null draws sets of
    the same sizes; the matched one keeps the numbers in each bucket of out-degree (a) and in-degree (b). back counts from
    b to a. A draw is a bit of a node's mask. Pairs within two steps are not listed: steps are counted at the node in their
    middle, by how many of either side meet there, and what a source reaches in more than one way is taken off again.
    Nodes have numbers, so that names are met once.
    """
    flags = lambda x, as_: x.select("name").distinct().withColumn(as_, F.lit(True))
    nodes = universe.select("name").filter("name is not null").distinct().join(flags(a, "in_a"), "name", "left").join(flags(b, "in_b"), "name", "left")
    nodes = materialize(numbered(nodes.select("name", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_a", "in_b"))), "name"), "citing")
    ids = lambda name, as_: nodes.select(F.col("name").alias(name), F.col("i").alias(as_))
    met = edges.select("src", "dst").filter("src <> dst").join(ids("src", "s"), "src").select("s", "dst").join(ids("dst", "t"), "dst")
    one = materialize(met.select("dst", "t", "s").distinct().select("s", "t"), "citations")  # dealt out by dst already
    degree = lambda side, as_: one.groupBy(F.col(side).alias("i")).agg(F.count("*").alias(as_))
    held = nodes.join(degree("s", "out"), "i", "left").join(degree("t", "in"), "i", "left")
    held = materialize(held.select("i", "name", "in_a", "in_b", *(degree_bucket(F.coalesce(c, F.lit(0))).alias(c) for c in ("out", "in"))), "citing")
    cited = held.filter(F.col("in") > 0).select(F.col("i").alias("node"))
    onward = one.select(F.col("s").alias("node"), F.col("t").alias("i")).join(cited, "node", "left_semi").union(cited.select("node", F.col("node").alias("i")))
    near = materialize(onward.repartition("node").sortWithinPartitions("node", "i").mapInArrow(packed.lists, "node long, chunk int, set binary"), "citations")
    sums: dict[tuple[int, str], list[int]] = {}
    seen: dict[int, tuple[int, int]] = {}
    for at in range(0, draws, BITS):
        some = range(at, min(at + BITS, draws))
        masks = drawn(held, seed, some)
        ends = materialize(one.join(masks.select(F.col("i").alias("s"), F.col("source").alias("mask")), "s"), "citations")
        told = lambda node, mask, kind: (F.col(node).alias("node"), F.col(mask).bitwiseOR(F.call_function("shiftleft", F.lit(kind).cast("long"), F.lit(62))).alias("mask"))
        into, of = ends.select(*told("t", "mask", CITING)), masks.select(*told("i", "target", ITSELF)).join(cited, "node", "left_semi")
        out = one.join(cited.withColumnRenamed("node", "s"), "s", "left_semi").join(masks.select(F.col("i").alias("t"), "target"), "t").select(*told("s", "target", CITED))
        middles = packed.sorted_parts(into.union(of).union(out), "node").mapInArrow(_at_middles, "key int, bit int, n long")
        steps = {(r["key"], r["bit"]): r["n"] for r in middles.groupBy("key", "bit").agg(F.sum("n").alias("n")).collect()}
        reached = ends.join(near, F.col("t") == F.col("node")).select(F.col("s").alias("node"), "mask", "chunk", "set")
        twice = packed.sorted_parts(reached, *packed.ROW).mapInArrow(packed.again, "i long, mask long")
        off = bit_sums(twice.join(masks, "i").select(F.lit(0).alias("key"), F.col("mask").bitwiseAND(F.col("target")).alias("mask")).filter("mask <> 0"))
        for hops in (1, 2):
            got = lambda bit: steps.get((1, bit), 0) + (steps.get((2, bit), 0) - off.get((0, bit), 0) if hops == 2 else 0)  # noqa: E731, B023
            seen[hops] = (got(BITS), got(2 * BITS + 1))
            for null, first in (("uniform", 0), ("matched", BITS + 1)):
                sums.setdefault((hops, null), []).extend(got(first + j) for j in range(len(some)))
    rows = []
    for (hops, null), values in sorted(sums.items()):
        mean = sum(values) / len(values)
        sd = math.sqrt(max(sum(v * v for v in values) / len(values) - mean * mean, 0.0))
        observed, back = seen[hops]
        rows.append((hops, null, observed, back, mean, sd, (observed - mean) / sd if sd else None, (sum(v >= observed for v in values) + 1) / (len(values) + 1)))
    return edges.sparkSession.createDataFrame(rows, "hops int, null string, observed long, back long, mean double, sd double, z double, p double")
