"""Rules over keys of the star schema, warrants, and validation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import derivations, records
from stratia.sources import derived

def _edges(spark: SparkSession, d: str) -> DataFrame:
    return derived.edges(spark, d).filter("lens = 'proof'").select("src", "dst")


def datalog_reach(spark: SparkSession, d: str) -> DataFrame:
    return derivations.closure(_edges(spark, d))


def datalog_negation(spark: SparkSession, d: str) -> DataFrame:
    """Of every supplier whether its nation is free of customers in deep debt."""
    c, s = derived.table(spark, d, "customer"), derived.table(spark, d, "supplier")
    bad = c.filter("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey")).distinct().withColumn("verdict", F.lit("debtor"))
    return s.join(bad, "s_nationkey", "left").select(F.col("s_suppkey").cast("string").alias("supplier"), F.col("s_nationkey").cast("string").alias("nation"), F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def _warranted(spark: SparkSession, d: str) -> DataFrame:
    warrant = F.when(F.col("src").startswith("nation:"), derivations.PROVED).when(F.col("src").startswith("supplier:"), derivations.STRUCTURAL).otherwise(derivations.ASSERTED)
    return _edges(spark, d).withColumn("warrant", warrant)


def warrants(spark: SparkSession, d: str) -> DataFrame:
    edges = _warranted(spark, d)
    found = derivations.closure_warrants(edges).select(derivations.fact("reach", "src", "dst").alias("fact"), "warrant")
    return edges.select(derivations.fact("edge", "src", "dst").alias("fact"), "warrant").union(found)


def explain_fact(spark: SparkSession, d: str) -> DataFrame:
    found = derivations.closure_explained(_warranted(spark, d))
    base, edge = F.col("via").isNull(), derivations.fact("edge", "src", "dst")
    step = F.concat_ws("&", derivations.fact("reach", "src", "via"), derivations.fact("edge", "via", "dst"))
    return found.select(derivations.fact("reach", "src", "dst").alias("fact"), F.when(base, "base").otherwise("step").alias("rule"), F.when(base, edge).otherwise(step).alias("inputs"), F.lit(0).cast("long").alias("missing"), "warrant")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    o = derived.table(spark, d, "orders")
    provenance = F.when(F.col("o_orderstatus") == "F", "formal").when(F.col("o_orderstatus") == "O", "derived").otherwise("assertion")
    inputs = F.when(F.col("o_orderstatus") == "O", F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") - 2)).otherwise(F.array().cast("array<bigint>"))
    return o.select(F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") % 4).alias("warrant"), provenance.alias("provenance"), inputs.alias("inputs"))


def fact_violations(spark: SparkSession, d: str) -> DataFrame:
    return records.fact_violations(_facts(spark, d))


def store_append(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    return records.append(facts, facts.filter("id % 7 = 0")).groupBy("provenance", "warrant").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def relation_violations(spark: SparkSession, d: str) -> DataFrame:
    kinds, evidence = [*records.KINDS, "guess"], [*records.EVIDENCE, "score"]
    pick = lambda v, k: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    rows = derived.table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(kinds, F.col("p_partkey")).alias("kind"), pick(evidence, F.col("p_size")).alias("evidence"), F.when(F.col("p_size") % 2 == 0, "both").otherwise("left-to-right").alias("direction"))
    return records.relation_violations(rows)


QUERIES = {f.__name__: f for f in (datalog_reach, datalog_negation, warrants, explain_fact, fact_violations, store_append, relation_violations)}

EDGES = derived.SQL["edges"] + ", e AS (SELECT src AS a, dst AS b FROM edges WHERE lens = 'proof')"
WARRANTED = f"""WITH RECURSIVE {EDGES}, given AS (SELECT a, b, CASE WHEN a LIKE 'nation:%' THEN 3 WHEN a LIKE 'supplier:%' THEN 2 ELSE 1 END AS w FROM e),
    reach(a, b, w, last) AS (SELECT a, b, least(w, 2), NULL::VARCHAR FROM given UNION ALL SELECT r.a, g.b, least(r.w, g.w), r.b FROM reach r JOIN given g ON r.b = g.a)"""
FACTS = """facts AS (SELECT o_orderkey AS id, CAST(o_orderpriority[1] AS INTEGER) % 4 AS warrant, CASE o_orderstatus WHEN 'F' THEN 'formal' WHEN 'O' THEN 'derived' ELSE 'assertion' END AS provenance FROM orders),
    support AS (SELECT f.id, count(*) FILTER (a.id IS NULL) + count(*) FILTER (b.id IS NULL) AS absent, greatest(max(a.warrant), max(b.warrant)) AS weakest FROM facts f LEFT JOIN facts a ON a.id = f.id - 1 LEFT JOIN facts b ON b.id = f.id - 2 WHERE f.provenance = 'derived' GROUP BY f.id),
    bad AS (SELECT id, f.warrant, provenance, CASE WHEN coalesce(absent, 0) > 0 THEN 'missing-input' WHEN f.warrant < CASE provenance WHEN 'formal' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END THEN 'above-ceiling' WHEN provenance = 'derived' AND f.warrant < weakest THEN 'above-support' END AS rule FROM facts f LEFT JOIN support USING (id))"""
SQL = {
    "datalog_reach": f"WITH RECURSIVE {EDGES}, r(src, dst) AS (SELECT a, b FROM e UNION SELECT r.src, e.b FROM r JOIN e ON r.dst = e.a) SELECT src, dst FROM r",
    "datalog_negation": "SELECT CAST(s_suppkey AS VARCHAR) AS supplier, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) THEN 'debtor' ELSE 'ok' END AS verdict FROM supplier",
    "warrants": WARRANTED + " SELECT 'edge,' || a || ',' || b AS fact, w AS warrant FROM given UNION ALL SELECT 'reach,' || a || ',' || b, max(w) FROM reach GROUP BY a, b",
    "explain_fact": WARRANTED + """ SELECT 'reach,' || a || ',' || b AS fact, CASE WHEN last IS NULL THEN 'base' ELSE 'step' END AS rule, CASE WHEN last IS NULL THEN 'edge,' || a || ',' || b ELSE 'reach,' || a || ',' || last || '&edge,' || last || ',' || b END AS inputs, 0 AS missing, w AS warrant
        FROM reach QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY w DESC, rule, inputs) = 1""",
    "fact_violations": f"WITH {FACTS} SELECT id, warrant, provenance, rule FROM bad WHERE rule IS NOT NULL",
    "store_append": f"WITH {FACTS} SELECT provenance, warrant, count(*) AS n, min(id) AS first FROM bad WHERE rule IS NULL AND id % 7 <> 0 GROUP BY 1, 2",
    "relation_violations": f"""WITH kinds(i, kind, w, sym) AS (VALUES {', '.join(f"({i}, '{k}', {w}, {str(s).lower()})" for i, (k, (w, s)) in enumerate(records.KINDS.items()))}, ({len(records.KINDS)}, 'guess', NULL, NULL)),
        ev(i, evidence, s) AS (VALUES {', '.join(f"({i}, '{k}', {w})" for i, (k, w) in enumerate(records.EVIDENCE.items()))}, ({len(records.EVIDENCE)}, 'score', 3)),
        r AS (SELECT p_partkey AS id, kind, evidence, CASE WHEN p_size % 2 = 0 THEN 'both' ELSE 'left-to-right' END AS direction, CASE WHEN w IS NULL THEN 'unknown-kind' WHEN s > w THEN 'weak-evidence' WHEN sym <> (p_size % 2 = 0) THEN 'direction' END AS rule
            FROM part JOIN kinds k ON k.i = p_partkey % {len(records.KINDS) + 1} JOIN ev v ON v.i = p_size % {len(records.EVIDENCE) + 1}) SELECT * FROM r WHERE rule IS NOT NULL""",
}
