"""Validation of typed relations and facts: which rows break which rule. Plain column expressions and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of relations with their warrant (0 the strongest) and whether they are symmetric.
PROVED, STRUCTURAL, ASSERTED, HEURISTIC = range(4)
KINDS = {
    "exact-statement": (STRUCTURAL, True), "presentation-equal": (STRUCTURAL, True), "definitional-rewrite": (STRUCTURAL, True), "type-equiv": (STRUCTURAL, True), "shared-instance": (STRUCTURAL, True),
    "proved-iff": (PROVED, True), "proved-implies": (PROVED, False), "shared-home-confirmed": (PROVED, True), "dictionary-row-confirmed": (PROVED, True), "transport-refuted": (PROVED, False), "transport-proved": (PROVED, False),
    "shared-home-candidate": (HEURISTIC, True), "structural-analogy": (HEURISTIC, True), "proof-shape-analogy": (HEURISTIC, True), "dictionary-row-candidate": (HEURISTIC, True),
    "asserted-iff": (ASSERTED, True), "asserted-implies": (ASSERTED, False),
}
EVIDENCE = {"theorem": PROVED, "counterexample": PROVED, "canonical-equality": STRUCTURAL, "dependency-path": STRUCTURAL, "axiom": ASSERTED}
# The strongest warrant (0 the strongest) that a fact's provenance allows.
CEILINGS = {"formal": PROVED, "oracle": PROVED, "structural": STRUCTURAL, "derived": STRUCTURAL, "assertion": ASSERTED, "empirical": ASSERTED}


def lookup(values: dict, column: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), column)


def relation_violations(relations: DataFrame) -> DataFrame:
    """relations (kind, evidence, direction, ...) that break a rule, with the rule.

    unknown-kind; weak-evidence: weaker than the kind's warrant; direction: symmetric kinds run both ways and others
    do not.
    """
    warrant, symmetric = lookup({k: v[0] for k, v in KINDS.items()}, F.col("kind")), lookup({k: v[1] for k, v in KINDS.items()}, F.col("kind"))
    strength = F.coalesce(lookup(EVIDENCE, F.col("evidence")), F.lit(HEURISTIC))
    rule = F.when(warrant.isNull(), "unknown-kind").when(strength > warrant, "weak-evidence").when(symmetric != (F.col("direction") == "both"), "direction")
    return relations.withColumn("rule", rule).filter("rule is not null")


def fact_violations(facts: DataFrame) -> DataFrame:
    """facts (id, warrant, provenance, inputs) that may not be inserted, with the first rule they break.

    duplicate-id; missing-input: a support that is no fact; above-ceiling: a warrant above what the provenance allows;
    above-support: a derived fact above its weakest input.
    """
    repeated = facts.groupBy("id").agg(F.count("*").alias("copies"))
    uses = facts.select("id", F.explode("inputs").alias("input")).distinct()
    support = uses.join(facts.groupBy(F.col("id").alias("input")).agg(F.min("warrant").alias("w")), "input", "left").groupBy("id").agg(F.count_if(F.col("w").isNull()).alias("absent"), F.max("w").alias("weakest"))
    rows = facts.join(repeated, "id").join(support, "id", "left")
    ceiling = F.coalesce(lookup(CEILINGS, F.col("provenance")), F.lit(HEURISTIC))
    rule = (
        F.when(F.col("copies") > 1, "duplicate-id")
        .when(F.coalesce("absent", F.lit(0)) > 0, "missing-input")
        .when(F.col("warrant") < ceiling, "above-ceiling")
        .when((F.col("provenance") == "derived") & (F.col("warrant") < F.col("weakest")), "above-support")
    )
    return rows.select("id", "warrant", "provenance", rule.alias("rule")).filter("rule is not null")


def append(facts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows of facts that a store takes: valid among themselves and with what is stored, ids not there yet."""
    every = facts if stored is None else facts.unionByName(stored.join(facts.select("id"), "id", "left_anti"))
    taken = facts.join(fact_violations(every).select("id"), "id", "left_anti")
    return taken if stored is None else taken.join(stored.select("id"), "id", "left_anti")
