"""Checks of frozen statements, claims, support expressions, artifact links and failures, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "x-stmt-v1"

# What becomes of an older fact, by its provenance.
DISPOSITIONS = {
    "oracle": "formal-evidence-pending-receipt", "formal": "formal-evidence-pending-receipt", "structural": "structural-evidence-candidate", "assertion": "documentary-evidence-candidate",
    "empirical": "empirical-evidence-candidate", "numerical": "numerical-evidence-candidate", "heuristic": "research-proposal", "candidate": "research-proposal",
}
# Kinds of artifact links, and the evidence that makes one formal.
ARTIFACT_KINDS = ("reified_as", "refined_into", "implemented_by", "validated_by", "observed_by", "derived_artifact")
FORMAL_EVIDENCE = ("theorem", "checked-certificate")
# Parts of messages that say why something failed, first match first, and what kinds mean otherwise.
MESSAGES = (("failed to synthesize", "instance-synthesis"), ("synth instance", "instance-synthesis"), ("type mismatch", "type-mismatch"), ("unknown identifier", "unknown-declaration"), ("unknown declaration", "unknown-declaration"), ("missing hypothesis", "missing-hypothesis"), ("unknown free variable", "missing-hypothesis"))
STALE = ("stale-handle", "stale-environment")


def verdict(encoding: Column, frozen: Column) -> Column:
    """How an encoding stands to its frozen digest `version:sha256:hex`.

    malformed-freeze comes before stale-freeze (frozen under another version), that before unknown-version of the
    encoding itself, and match and differs are the rest. Null encodings and freezes have no verdict.
    """
    fields = F.split(frozen, ":", 3)
    part = lambda i: F.get(fields, F.lit(i))
    sound = (F.size(fields) == 3) & (part(1) == "sha256") & part(2).rlike("^[0-9A-Fa-f]+$")
    digest = F.concat(F.lit(f"{VERSION}:sha256:"), F.sha2(encoding, 256))
    return (
        F.when(encoding.isNull() | frozen.isNull(), None)
        .when(~F.coalesce(sound, F.lit(False)), "malformed-freeze")
        .when(part(0) != VERSION, "stale-freeze")
        .when(F.substring_index(encoding, ";", 1) != VERSION, "unknown-version")
        .when(digest == frozen, "match")
        .otherwise("differs")
    )


def disposition(provenance: Column, proved: Column, inputs: Column) -> Column:
    """What becomes of an older fact: nothing of it is evidence yet.

    A formal fact that was proved has no receipt; a derived one needs an input; unknown provenance is an assertion.
    """
    listed = F.element_at(F.create_map(*(F.lit(x) for pair in DISPOSITIONS.items() for x in pair)), provenance)
    derived = F.when(F.coalesce(F.size(inputs), F.lit(0)) > 0, "structural-evidence-candidate").otherwise("legacy-unverified-structural")
    return F.when((provenance == "formal") & proved, "legacy-unverified-formal").when(provenance == "derived", derived).otherwise(F.coalesce(listed, F.lit("legacy-unattributed-assertion")))


def claim_violations(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """claims (claim, relation, args, scope, evidence, targets) with the first rule that each breaks.

    relations: (relation, arguments, scope_policy, admissible), one row each; args and arguments are lists of types. Rules:
    unknown-relation, wrong-arity, wrong-argument-type, scope-required, evidence-not-allowed, no-targets.
    """
    rows = claims.join(F.broadcast(relations) if relations.count() <= 10_000 else relations, "relation", "left")
    types = F.exists(F.arrays_zip("args", "arguments"), lambda x: ~x["args"].eqNullSafe(x["arguments"]))
    rule = (
        F.when(F.col("arguments").isNull(), "unknown-relation")
        .when(F.coalesce(F.size("args"), F.lit(-1)) != F.size("arguments"), "wrong-arity")
        .when(types, "wrong-argument-type")
        .when((F.col("scope_policy") == "required") & F.coalesce(F.col("scope") == "not-applicable", F.lit(True)), "scope-required")
        .when(~F.coalesce(F.array_contains("admissible", F.col("evidence")), F.lit(False)), "evidence-not-allowed")
        .when(F.coalesce(F.size("targets"), F.lit(0)) <= 0, "no-targets")
    )
    return rows.select("claim", "relation", rule.alias("rule")).filter("rule is not null")


def support_violations(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes of support expressions that break a rule: (expression, node, rule).

    nodes: (expression, node, parent, op, k, ref): op is all, any, at-least or rule over the nodes whose parent it is, or
    evidence with a reference. Rules: empty (no input), threshold (at-least of 0 or of more than there are), missing (a
    reference that `known` (ref) lacks).
    """
    inputs = nodes.filter("parent is not null").groupBy("expression", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    rows = nodes.join(inputs, ["expression", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.join(known.select("ref", F.lit(True).alias("there")).distinct(), "ref", "left")
    rule = (
        F.when((F.col("op") == "evidence") & F.col("there").isNull(), "missing")
        .when((F.col("op") == "at-least") & ((F.coalesce("k", F.lit(0)) < 1) | (F.col("k") > F.col("n"))), "threshold")
        .when(F.col("op").isin("all", "any", "rule") & (F.col("n") == 0), "empty")
    )
    return rows.select("expression", "node", rule.alias("rule")).filter("rule is not null")


def artifact_links(links: DataFrame) -> DataFrame:
    """links (kind, evidence, ...) with `rule` where one may not be made, and whether it is a formal bridge.

    Only a theorem or a checked certificate makes something reified_as; with such evidence that and refined_into are bridges.
    """
    formal = F.coalesce(F.col("evidence").isin(*FORMAL_EVIDENCE), F.lit(False))
    rule = F.when(~F.coalesce(F.col("kind").isin(*ARTIFACT_KINDS), F.lit(False)), "unknown-kind").when((F.col("kind") == "reified_as") & ~formal, "insufficient-evidence")
    return links.withColumn("rule", rule).withColumn("formal_bridge", rule.isNull() & formal & F.col("kind").isin("reified_as", "refined_into"))


def failure_class(message: Column, kind: Column, missing_instances: Column) -> Column:
    """Why something failed: by what was missing, then by the message, then by the kind that was reported."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(F.coalesce(missing_instances, F.lit(0)) > 0, "instance-synthesis")
    for text, name in MESSAGES:
        out = out.when(low.contains(text), name)
    return out.when(kind.isin(*STALE), "stale-context").otherwise(kind)


def excluded_role(name: Column, roles: list[str]) -> Column:
    """Whether a name's last component is one of the roles; a role that ends in * stands for all that start so."""
    last = F.substring_index(name, ".", -1)
    exact, starts = [r for r in roles if not r.endswith("*")], [r[:-1] for r in roles if r.endswith("*")]
    out = last.isin(*exact) if exact else F.lit(False)
    for s in starts:
        out = out | last.startswith(s)
    return out


def reference_violations(rows: DataFrame, key: str, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """(key, missing): references of rows, single or listed, to records that are not there."""
    listed = rows.schema[column].dataType.simpleString().startswith("array")
    each = rows.select(key, (F.explode(column) if listed else F.col(column)).alias("missing")).filter("missing is not null").distinct()
    return each.join(parents.select(F.col(parent).alias("missing")).distinct(), "missing", "left_anti").select(key, "missing")
