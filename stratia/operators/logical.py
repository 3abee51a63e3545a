"""Logical edges between the heads of propositions: which theorems prove that one pattern gives another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratia.functions import terms
from stratia.operators import graph
from stratia.operators.statements import is_prop, spread

SIDES = "root string, form string, l string, r string, lhead string, rhead string"


def head_key(term) -> tuple[str, str] | None:
    """Head with arity, and the bare head; quantifiers in front count in the name. None for a variable head."""
    depth = 0
    while term[0] == "p":
        depth, term = depth + 1, term[3]
    head, args = terms.spine(term)
    if head[0] != "c":
        return None
    name = head[1][0]
    return f"{f'∀{depth}.' if depth else ''}{name}/{len(args)}", f"{f'∀{depth}.' if depth else ''}{name}"


def _mentions(term, k: int) -> bool:
    if term[0] == "b":
        return term[1] == k
    return any(_mentions(c, k + u) for c, u in zip(term[2:], terms.binds(term), strict=True))


def both_sides(term) -> tuple[str, object, object] | None:
    """(form, left, right): the sides of an equivalence, else of the first premise that nothing behind it mentions."""
    head, args = terms.spine(terms.conclusion(term))
    if head[0] == "c" and head[1][0] == "Iff" and len(args) == 2:
        return "iff", *args
    while term[0] == "p":
        if not _mentions(term[3], 0):
            return "implies", term[2], term[3]
        term = term[3]
    return None


def sides(parsed: DataFrame) -> DataFrame:
    """One row for each distinct statement of theorems and axioms: its form (iff, implies, none) and the keys of its sides (null: no constant head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for root in b.column(0).to_pylist():
                found = both_sides(terms.parse("x-stmt-v1;" + root))
                keys = [head_key(s) for s in found[1:]] if found else [None, None]
                (l, lh), (r, rh) = ((None, None) if k is None else k for k in keys)  # noqa: E741
                rows.append({"root": root, "form": found[0] if found else "none", "l": l, "r": r, "lhead": lh, "rhead": rh})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string()) for n in ("root", "form", "l", "r", "lhead", "rhead")]))

    return spread(_asserted(parsed).select("root").distinct()).mapInArrow(run, SIDES)


def _asserted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind").isin("theorem", "axiom"))


def prop_heads(parsed: DataFrame) -> DataFrame:
    """(head): constants that head the conclusion of some proposition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [terms.spine(terms.parse("x-stmt-v1;" + c))[0] for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h[1][0] for h in heads if h[0] == "c"], pa.string())], names=["head"])

    return parsed.filter(is_prop(F.col("kind"), F.col("concludes"))).select("concludes").distinct().mapInArrow(run, "head string").distinct()


def _judged(parsed: DataFrame) -> DataFrame:
    heads = prop_heads(parsed)
    s = sides(parsed)
    for side in ("l", "r"):
        s = s.join(heads.select(F.col("head").alias(f"{side}head"), F.lit(True).alias(f"{side}prop")), f"{side}head", "left")
    flex, same = F.col("l").isNull() | F.col("r").isNull(), F.col("l") == F.col("r")
    outside = F.col("lprop").isNull() | F.col("rprop").isNull()
    what = F.when(F.col("form") == "none", "none").when(flex, "flex").when((F.col("form") == "implies") & outside, "non-prop").when(same, "same").otherwise("edge")
    rows = _asserted(parsed).select("seq", F.col("name").alias("theorem"), (F.col("kind") == "axiom").alias("asserted"), "root")
    return rows.join(s.withColumn("what", what).hint("merge"), "root")  # what a statement says is judged once


def edges(parsed: DataFrame) -> DataFrame:
    """(seq, theorem, asserted, form, l, r): one edge a theorem whose sides have heads of propositions."""
    return _judged(parsed).filter("what = 'edge'").select("seq", "theorem", "asserted", "form", "l", "r")


def stats(parsed: DataFrame) -> DataFrame:
    """Counts of what was scanned, of edges, and of sides that gave none."""
    on = lambda form, what: F.count_if((F.col("form") == form) & (F.col("what") == what))
    found = _judged(parsed).agg(
        F.count_if(~F.col("asserted")).alias("theorems_scanned"), F.count_if("asserted").alias("axioms_scanned"), on("iff", "edge").alias("iff_edges"), on("implies", "edge").alias("implication_edges"),
        F.count_if(F.col("what") == "flex").alias("flex_head_sides"), on("iff", "same").alias("same_head_sides"), F.count_if(F.col("what") == "non-prop").alias("non_prop_sides"),
    )
    return found.join(prop_heads(parsed).agg(F.count("*").alias("prop_heads")))


def from_heads(found: DataFrame) -> DataFrame:
    """Edges seen from each head that they leave; equivalences from either end."""
    turned = found.filter("form = 'iff'").select("seq", "theorem", "asserted", "form", F.col("r").alias("l"), F.col("l").alias("r"))
    return found.union(turned)


def busiest(found: DataFrame, top: int = 20) -> DataFrame:
    """Heads by how many ends of edges they are."""
    ends = found.select(F.col("l").alias("head")).union(found.select(F.col("r")))
    return ends.groupBy("head").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "head").limit(top)


def paths(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target, path): from each source head a shortest chain of proved edges, heads in order."""
    proved = from_heads(found.filter("not asserted")).select(F.col("l").alias("src"), F.col("r").alias("dst"), F.lit("proof").alias("lens"))
    return graph.why(proved, sources, F.lit(True))


def survey(counters: DataFrame, degrees: DataFrame, classes: dict[str, DataFrame], hub: int = 10) -> DataFrame:
    """(measure, n): what relations a corpus yields: its logical counters, heads and hubs, and classes at each level.

    counters: one row, as stats() gives it; degrees: (head, n); classes: of each level (canon, n). A hub is a head of at
    least `hub` edges. Each part is a few sums, whatever the corpus.
    """
    out = counters.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in counters.columns))).alias("m")).select("m.*")
    some = degrees.agg(F.count("*").alias("heads"), F.count_if(F.col("n") >= hub).alias("hubs"), F.coalesce(F.max("n"), F.lit(0)).alias("busiest"))
    tables = [some] + [df.agg(F.count("*").alias(f"classes_{level}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"members_{level}")) for level, df in classes.items()]
    for t in tables:
        out = out.union(t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in t.columns))).alias("m")).select("m.*"))
    return out
