"""Ways to a proof of statements that have none: equivalents, conclusions, and more general statements that are proved.

Rows are parsed statements with `proved`. Proved rows are counted by what is compared before anything is joined, so that
copies of a statement, or a class of any size, are one row.

Defined cases: a statement's own row is never its proof; statements without a parsed term are not among the rows; where
names repeat, each row counts; no proved rows give no ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratia.functions import terms
from stratia.operators import statements as st
from stratia.session import checkpoint, materialize

#: Levels that are compared, the finest first; a shape forgets too much to be a way.
LEVELS = terms.LEVELS[:-1]


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.filter("proved").groupBy(*keys).agg(F.count("*").alias("proofs"), F.min("name").alias("proof"))


def equivalents(parsed: DataFrame) -> DataFrame:
    """(name, level, proofs, proof): of unproved rows the proved ones that are equal at each level of erasure, and the first."""
    out = None
    for level in LEVELS:
        rows = checkpoint(st.erased(parsed, level).select("name", "proved", "erased"))
        one = rows.filter("not proved").select("name", "erased").join(_counted(rows, "erased"), "erased").select("name", F.lit(level).alias("level"), "proofs", "proof")
        out = one if out is None else out.union(one)
    return out


def conclusions(parsed: DataFrame) -> DataFrame:
    """(name, tier, proofs, proof, edits): proved rows that conclude the same as an unproved one, whatever they suppose.

    Tier "identical": the conclusions are equal; "same_tree": equal but for names of constants, where edits has the
    distinct (mine, theirs) of the first such row. Rows of the first tier are in the second too.
    """
    rows = materialize(_trees(parsed), "conclusions")
    open_ = rows.filter("not proved")
    same = open_.join(_counted(rows, "concludes"), "concludes").select("name", F.lit("identical").alias("tier"), "proofs", "proof", F.array().cast("array<struct<s: string, t: string>>").alias("edits"))
    first = rows.filter("proved").groupBy("tree").agg(F.count("*").alias("proofs"), F.min(F.struct("name", "slots")).alias("f"))
    pairs = F.array_sort(F.array_distinct(F.filter(F.arrays_zip(F.col("slots").alias("s"), F.col("f.slots").alias("t")), lambda e: e["s"] != e["t"])))
    near = open_.join(first, "tree").select("name", F.lit("same_tree"), "proofs", F.col("f.name"), pairs.cast("array<struct<s: string, t: string>>"))
    return same.union(near)


def _trees(parsed: DataFrame) -> DataFrame:
    """(name, proved, concludes, tree, slots): the conclusion with blanked names, and those names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [terms.rigid(terms.parse("x-stmt-v1;" + c)) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([terms.render(t) for t, _ in made], pa.string()), pa.array([s for _, s in made], pa.list_(pa.string()))], names=["name", "proved", "concludes", "tree", "slots"])

    return parsed.select("name", "proved", "concludes").mapInArrow(run, "name string, proved boolean, concludes string, tree string, slots array<string>")


def marks(term) -> tuple[str, list[str]]:
    """What a term and all that it matches have in common: (front, names).

    front: the number of leading binders, and head and arity of what follows; names: its constants, projections and
    literals, once each. A pattern matches only terms with its front that have all its names.
    """
    n, t = 0, term
    while t[0] == "p":
        n, t = n + 1, t[3]
    head, args = terms.spine(t)
    names = {f"c{x[1][0]}" if x[0] in "cj" else f"{x[0]}{x[1]}" for x in terms.walk(term) if x[0] in "cjnt"}
    return f"{n} {len(args)} {head[0]}{head[1][0] if head[0] in 'cj' else ''}", sorted(names)


def _marked(rows: DataFrame, column: str) -> DataFrame:
    """(term, front, names) of the distinct terms of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [marks(terms.parse("x-stmt-v1;" + t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in made], pa.string()), pa.array([n for _, n in made], pa.list_(pa.string()))], names=["term", "front", "names"])

    return rows.select(F.col(column).alias("term")).distinct().mapInArrow(run, "term string, front string, names array<string>")


@lru_cache(maxsize=4096)
def _term(text: str):
    return terms.parse("x-stmt-v1;" + text)


def containing(patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """(pattern, target): targets with the front of a pattern that have all its names; both are (term, front, names).

    A pattern meets targets by front and by the one of its names that the fewest targets have; the rest of its names are
    tested on what meets. Patterns without names meet all targets of their front.
    """
    tokens = targets.select("front", F.explode("names").alias("token"))
    often = tokens.groupBy("front", "token").agg(F.count("*").alias("df"))
    asked = patterns.select("term", "front", F.explode_outer("names").alias("token")).join(often, ["front", "token"], "left")
    # A name that no target has rules the pattern out: df 0 comes first, and meets nothing.
    rarest = asked.groupBy("term", "front").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("m")).select("term", "front", F.col("m.token").alias("token"))
    keyed = patterns.join(rarest, ["term", "front"]).select(F.col("term").alias("pattern"), "front", "token", F.col("names").alias("asks"))
    has = targets.select(F.col("term").alias("target"), "front", "names", F.explode("names").alias("token"))
    inside = F.size(F.array_except("asks", "names")) == 0
    named = keyed.filter("token is not null").join(has, ["front", "token"]).filter(inside).select("pattern", "target")
    bare = keyed.filter("token is null").join(targets.select(F.col("term").alias("target"), "front"), "front").select("pattern", "target")
    return named.union(bare)


def matching(pairs: DataFrame) -> DataFrame:
    """Of (pattern, target) those in which the target is an instance of the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [terms.matches(_term(p), _term(t)) is not None for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return pairs.select("pattern", "target").mapInArrow(run, "pattern string, target string")


def subsumptions(parsed: DataFrame, level: str = "carriers") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, patterns, targets): which distinct statements are instances of which proved, erased ones.

    links: (pattern, target) between distinct terms; patterns: (pattern, name) of the proved rows, erased at `level`;
    targets: (target, name) of all rows, at presentation, since a finer text would differ from a pattern by what erasing
    rewrites. Copies and rows alike after erasing are one term, so that links grow with the distinct statements.
    """
    patterns = checkpoint(st.erased(parsed, level).filter("proved").select(F.col("erased").alias("pattern"), "name"))
    targets = checkpoint(st.erased(parsed, "presentation").select(F.col("erased").alias("target"), "name"))
    found = containing(checkpoint(_marked(patterns, "pattern")), checkpoint(_marked(targets, "target")))
    return checkpoint(matching(found)), patterns, targets


def subsumers(parsed: DataFrame, level: str = "carriers") -> DataFrame:
    """(name, proofs, proof): of each row how many other proved rows state something more general, and the first of them."""
    links, patterns, targets = subsumptions(parsed, level)
    second = F.min(F.when(F.col("name") != F.col("a"), F.col("name")))
    firsts = patterns.groupBy("pattern").agg(F.min("name").alias("a"), F.count("*").alias("n"))
    known = patterns.join(firsts, "pattern").groupBy("pattern", "a", "n").agg(second.alias("b"))
    met = checkpoint(links.join(known, "pattern"))
    best = met.groupBy("target").agg(F.min("a").alias("first"), F.sum("n").alias("n"))
    # The second name over all patterns of a target: the others' first, or the second of the pattern that has the first.
    next_ = met.join(best.select("target", "first"), "target").groupBy("target").agg(F.min(F.when(F.col("a") == F.col("first"), F.col("b")).otherwise(F.col("a"))).alias("next"))
    own = patterns.withColumnRenamed("pattern", "mine").select("name", F.lit(1).alias("own")).distinct()
    rows = targets.join(best, "target").join(next_, "target").join(own, "name", "left")
    proofs = F.col("n") - F.coalesce("own", F.lit(0))
    return rows.select("name", proofs.alias("proofs"), F.when(F.col("first") == F.col("name"), F.col("next")).otherwise(F.col("first")).alias("proof")).filter("proofs > 0")

