"""The citation graph: lenses, reachability, shortest paths, degree ranking, trust audit.

Edges are (src, dst, lens). Searches run breadth first for all sources at once: each round joins the frontier with the
edges, drops what is known by an anti-join and checkpoints, so that a round's cost follows its frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.functions import packed
from stratia.functions.numbering import numbered
from stratia.session import checkpoint, materialize, shuffle_partitions

LENSES = ("statement", "proof", "both")
MAX_ROUNDS = 10_000
#: Rounds after which what is known is written anew, as one table of the usual number of parts.
COMPACT = 8
#: Axioms that the audit lets pass unless told otherwise (fixed values of the domain), and its mark of a gap.
TRUSTED = ("propext", "Classical.choice", "Quot.sound")
GAP = "sorryAx"


def check_choice(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; one of {', '.join(allowed)}")


def through(edges: DataFrame, lens: str = "both") -> DataFrame:
    """The distinct (src, dst) that a lens shows."""
    check_choice(lens, LENSES, "lens")
    return (edges if lens == "both" else edges.filter(F.col("lens") == lens)).select("src", "dst").distinct()


def _compact(seen: DataFrame, i: int, *keys: str) -> DataFrame:
    return seen if i % COMPACT else checkpoint(seen.repartition(shuffle_partitions(seen.sparkSession), *keys))


def reach(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node): what each source's edges lead to, itself excluded even on a cycle.

    sources: one column `source`; it need not be declared, and nodes outside the declarations count.
    """
    pairs = checkpoint(pairs)
    frontier = checkpoint(sources.select("source", F.col("source").alias("node")).distinct())
    seen = frontier
    for i in range(1, MAX_ROUNDS):
        step = frontier.join(pairs, frontier.node == pairs.src).select("source", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen.filter("node <> source")
        seen = _compact(seen.union(frontier), i, "source", "node")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def reachable(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): what any of the roots (column node) leads to, and the roots; one mark a node, whatever the roots."""
    pairs = checkpoint(pairs)
    seen = frontier = checkpoint(roots.select("node").distinct())
    for i in range(1, MAX_ROUNDS):
        step = frontier.join(pairs, frontier.node == pairs.src).select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _compact(seen.union(frontier), i, "node")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def orphans(edges: DataFrame, names: DataFrame, lens: str = "both") -> DataFrame:
    """(name): definitions that no theorem rests on."""
    theorems = names.filter("kind = 'theorem'").select(F.col("name").alias("node"))
    used = reachable(through(edges, lens), theorems)
    return names.filter("kind = 'def'").select("name").join(used.select(F.col("node").alias("name")), "name", "left_anti")


def foundations(edges: DataFrame, sources: DataFrame, lens: str = "both") -> DataFrame:
    """(source, node): all that each source rests on."""
    return reach(through(edges, lens), sources)


def impact(edges: DataFrame, sources: DataFrame, lens: str = "both") -> DataFrame:
    """(source, node): all that rests on each source."""
    return reach(through(edges, lens).select(F.col("dst").alias("src"), F.col("src").alias("dst")), sources)


def _followed(edges: DataFrame, lens: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, sets, outer): numbers of what edges lead to by name, what each of those leads to, and what the others do.

    nodes: (node, i); sets: (node, i, chunk, set), the node itself included; outer: the same of sources that nothing leads
    to, in rows that are not joined yet. No one passes an outer source's set on, so it is made once, of its edges' sets.
    """
    check_choice(lens, LENSES, "lens")
    pairs = (edges if lens == "both" else edges.filter(F.col("lens") == lens)).select("src", "dst").filter("src is not null and dst is not null")
    pairs = materialize(pairs, "pairs")
    nodes = materialize(numbered(pairs.select(F.col("dst").alias("node")).distinct(), "node"), "nodes")
    ends = materialize(pairs.join(nodes.select(F.col("node").alias("src"), F.col("i").alias("at")), "src", "left").select("src", "at", "dst"), "ends")
    seen = frontier = materialize(packed.singles(nodes), "sets")
    for i in range(1, MAX_ROUNDS):
        frontier = materialize(packed.fresh(packed.onward(ends.filter("at is not null"), frontier), seen), "sets")
        if frontier.isEmpty():
            sets = materialize(packed.union(seen), "sets")
            return nodes, sets, packed.onward(ends.filter("at is null"), sets)
        seen = seen.union(frontier)
        seen = seen if i % COMPACT else materialize(packed.union(seen), "sets")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def foundation_sizes(edges: DataFrame, sources: DataFrame, lens: str = "both") -> DataFrame:
    """(source, n, first_node): on how much each source rests, itself aside, and the first name of it; no row where on nothing.

    As foundations() counted, but for all nodes at once, whose sets stay packed.
    """
    nodes, sets, outer = _followed(edges, lens)
    kind = "node string, n long, low long"
    parts = packed.sorted_parts(outer, *packed.ROW).mapInArrow(lambda batches: packed.sized(packed.sweep(batches, packed.ROW)), kind).union(sets.mapInArrow(packed.sized, kind))
    found = parts.groupBy(F.col("node").alias("source")).agg(F.sum("n").alias("n"), F.min("low").alias("i")).join(sources.select("source").distinct(), "source", "left_semi")
    return found.join(nodes, "i").select("source", "n", F.col("node").alias("first_node"))


def bridge_centrality(edges: DataFrame, sources: DataFrame, lens: str = "both") -> DataFrame:
    """(source, n): how much rests on each source; 0 where nothing does.

    Counted over what each node rests on, whose sets stay packed: what a leaf of the other direction has is small.
    """
    nodes, sets, outer = _followed(edges, lens)
    kind = "i long, n long"
    parts = packed.sorted_parts(outer, *packed.ROW).mapInArrow(lambda batches: packed.counted(packed.sweep(batches, packed.ROW)), kind).union(sets.mapInArrow(packed.counted, kind))
    counts = parts.groupBy("i").agg(F.sum("n").alias("n")).join(nodes, "i").select(F.col("node").alias("source"), "n")
    return sources.select("source").distinct().join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Targets that a row of a node holds, or so.
WIDTH = 1000


def _back(pairs: DataFrame, sources: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """why() from n targets backwards: (source, target, path).

    A node's best path is its own name before the best of those that it leads to, and those differ in their first name.
    So a search keeps the next name alone, for all targets of a node in one row or a few; paths are put together after it,
    shortest first.
    """
    kinds = "array<struct<start: string, next: string>>"
    bucket = F.pmod(F.hash("start"), F.lit(-(-n // WIDTH) or 1)).alias("bucket")
    frontier = materialize(targets.select("node", F.col("node").alias("start")).select("node", bucket, F.array(F.struct("start", F.lit(None).cast("string").alias("next"))).cast(kinds).alias("found")), "why")
    rounds, seen = [frontier], frontier
    for i in range(1, MAX_ROUNDS):
        starts = F.transform("found", lambda x: x["start"]).alias("starts")
        step = frontier.join(pairs, frontier.node == pairs.dst).select(F.col("src").alias("node"), "bucket", F.col("dst").alias("next"), starts)
        both = step.union(seen.select("node", "bucket", F.lit(None).cast("string"), starts)).repartition("node")  # by node alone: what follows stays in its part
        best = both.select("node", "bucket", "next", F.explode("starts").alias("start")).groupBy("node", "bucket", "start").agg(F.min("next").alias("next"), F.count_if(F.col("next").isNull()).alias("known"))
        frontier = materialize(best.filter("known = 0").groupBy("node", "bucket").agg(F.collect_list(F.struct("start", "next")).cast(kinds).alias("found")), "why")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        seen = seen.union(frontier)
        seen = seen if i % COMPACT else materialize(seen.repartition("node"), "why")
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    asked = sources.select("node").withColumn("asked", F.lit(True))
    out = before = None
    for k, one in enumerate(rounds):
        each = one.join(asked, "node", "left").select("node", F.coalesce("asked", F.lit(False)).alias("asked"), F.inline("found"))
        if before is None:
            paths = each.select("start", "node", "asked", F.array("node").alias("path"))
        else:
            ends = before.select("start", F.col("node").alias("next"), F.col("path").alias("rest"))
            paths = each.join(ends, ["start", "next"]).select("start", "node", "asked", F.concat(F.array("node"), "rest").alias("path"))
        before = materialize(paths, "paths") if k + 1 < len(rounds) else paths
        out = before if out is None else out.union(before)
    return out.filter("asked").select(F.col("node").alias("source"), F.col("start").alias("target"), "path")


def why(edges: DataFrame, sources: DataFrame, is_target: Column, lens: str = "both") -> DataFrame:
    """(source, target, path): of each source and each node that meets `is_target` (over column node) a shortest path.

    Of shortest paths the one whose names come first in order; a source that is a target has the path of itself. The search
    starts from the fewer of sources and targets, so that a node has one path for each of those.
    """
    check_choice(lens, LENSES, "lens")
    pairs = materialize((edges if lens == "both" else edges.filter(F.col("lens") == lens)).select("src", "dst").filter("src is not null and dst is not null"), "pairs")
    sources = materialize(sources.select(F.col("source").alias("node")).filter("node is not null").distinct(), "sources")
    targets = checkpoint(pairs.select(F.col("dst").alias("node")).filter(is_target).union(sources.filter(is_target)).distinct())
    if (n := targets.count()) < sources.count():
        return _back(pairs, sources, targets, n)
    seen = frontier = checkpoint(sources.select(F.col("node").alias("start"), "node", F.array("node").alias("path")))
    for i in range(1, MAX_ROUNDS):
        step = frontier.join(pairs, frontier.node == pairs.src).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = checkpoint(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen.join(targets, "node", "left_semi").select(F.col("start").alias("source"), F.col("node").alias("target"), "path")
        seen = _compact(seen.union(frontier), i, "start", "node")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def citations(edges: DataFrame, names: DataFrame, lens: str = "both") -> DataFrame:
    """(name, citations): distinct direct citers of each declared name."""
    counts = through(edges, lens).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("citations"))
    return names.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("citations", F.lit(0)).cast("long").alias("citations"))


def walls(edges: DataFrame, names: DataFrame, lens: str = "both", top: int = 20) -> DataFrame:
    """The most cited declared names, most first, ties by name; names without citers don't count."""
    return citations(edges, names, lens).filter("citations > 0").orderBy(F.col("citations").desc(), "name").limit(top)


def honesty(edges: DataFrame, names: DataFrame, trusted: tuple[str, ...] | None = None, gap: str = GAP) -> DataFrame:
    """(name): what rests, by proofs, on the mark of a gap or on an axiom that is not trusted, and such axioms.

    An empty tuple trusts nothing; None stands for the usual axioms.
    """
    trusted = TRUSTED if trusted is None else trusted
    axioms = names.filter("kind = 'axiom'").filter(~F.col("name").isin(*trusted) if trusted else F.lit(True)).select(F.col("name").alias("source"))
    roots = axioms.union(names.sparkSession.range(1).select(F.lit(gap).alias("source")))
    reached = impact(edges, roots, "proof").select(F.col("node").alias("name"))
    return reached.union(axioms.select(F.col("source").alias("name"))).distinct()


def theory_of(module: Column) -> Column:
    """The first component of a module, or the first two below Mathlib."""
    return F.when(module.startswith("Mathlib."), F.substring_index(module, ".", 2)).otherwise(F.substring_index(module, ".", 1))


def module_root(module: Column) -> Column:
    """Like theory_of, but a module of two components below Mathlib has root Mathlib."""
    deep = module.startswith("Mathlib.") & (F.size(F.split(module, r"\.")) > 2)
    return F.when(deep, F.substring_index(module, ".", 2)).otherwise(F.substring_index(module, ".", 1))


def in_theory(module: Column, theory: str) -> Column:
    """Whether a module is a theory or lies below it, by whole components."""
    return (module == theory) | module.startswith(theory + ".")


def cross_citations(edges: DataFrame, theories: DataFrame) -> DataFrame:
    """(left, right, n): uses between two theories, either way; theories: (name, theory). Edges count as often as given."""
    of = lambda side, name: theories.select(F.col("name").alias(side), F.col("theory").alias(name))
    both = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b")
    return both.groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.count("*").alias("n"))
