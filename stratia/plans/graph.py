"""Graph queries over the derived corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import graph
from stratia.sources import derived, slices

E, N = derived.SQL["edges"], derived.SQL["names"]


def walls(spark: SparkSession, d: str) -> DataFrame:
    return graph.walls(derived.edges(spark, d), derived.names(spark, d))


def _every(spark: SparkSession, d: str) -> DataFrame:
    return derived.names(spark, d).select(F.col("name").alias("source"))


def citations_by_lens(spark: SparkSession, d: str) -> DataFrame:
    e, n = derived.edges(spark, d), derived.names(spark, d)
    parts = [graph.citations(e, n, lens).select(F.lit(lens).alias("lens"), "name", "citations") for lens in graph.LENSES]
    return parts[0].union(parts[1]).union(parts[2])


def foundations_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.foundation_sizes(derived.edges(spark, d), _every(spark, d))


def impact_all(spark: SparkSession, d: str) -> DataFrame:
    found = graph.impact(derived.edges(spark, d), _every(spark, d), "proof")
    return found.groupBy("source", F.substring_index("node", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def bridge_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Of every name, by edges of both lenses, as suppliers and parts are used by statements alone."""
    return graph.bridge_centrality(derived.edges(spark, d), _every(spark, d))


def why_path(spark: SparkSession, d: str) -> DataFrame:
    found = graph.why(derived.edges(spark, d), _every(spark, d), F.col("node").startswith("region:"))
    return found.select("source", "target", F.array_join("path", ">").alias("path"))


def honesty(spark: SparkSession, d: str) -> DataFrame:
    return graph.honesty(derived.edges(spark, d), derived.names(spark, d), trusted=("region:0", "region:1", "region:2"), gap="nation:7")


def theory_sizes(spark: SparkSession, d: str) -> DataFrame:
    return derived.declarations(spark, d).groupBy(graph.theory_of(F.substring_index("module", ".", -2)).alias("theory")).agg(F.count("*").alias("n"), F.count("stmt").alias("encoded"))


def cross_citations(spark: SparkSession, d: str) -> DataFrame:
    theories = derived.names(spark, d).select("name", F.substring_index("module", ".", -1).alias("theory"))
    return graph.cross_citations(derived.edges(spark, d), theories)


def cyclic_reach(spark: SparkSession, d: str) -> DataFrame:
    """Event types that lead to one another within a user's trace: a graph with cycles."""
    t = derived.events(spark, d)
    pairs = t.alias("a").join(t.alias("b"), F.expr("a.problem = b.problem and b.step = a.step + 1")).select(F.col("a.method").alias("src"), F.col("b.method").alias("dst"), F.lit("proof").alias("lens"))
    return graph.foundations(pairs, t.select(F.col("method").alias("source")).distinct())


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nations that no supplier in debt sits in."""
    debtors = derived.table(spark, d, "supplier").filter("s_acctbal < 0").select(derived.node("supplier", "s_suppkey").alias("name"), F.lit("theorem").alias("kind"))
    kinds = derived.names(spark, d).filter("kind = 'def'").select("name", "kind").union(debtors)
    return graph.orphans(derived.edges(spark, d), kinds)


def _slice(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a slice, every tenth without its kind."""
    c = derived.table(spark, d, "customer")
    row = F.struct(
        F.lit("x-row-v2").alias("schema"), derived.node("customer", "c_custkey").alias("name"), F.when(F.col("c_custkey") % 10 != 0, "theorem").alias("kind"), F.concat(F.lit("Trade."), "c_mktsegment").alias("module"), F.lit(False).alias("is_instance"),
        F.concat(F.lit("x-stmt-v1;n"), F.col("c_custkey").cast("string")).alias("stmt"), F.array(derived.node("nation", "c_nationkey")).alias("uses_statement"), F.array().cast("array<string>").alias("uses_proof"), F.array().cast(slices.REQUIREMENTS).alias("requirements_statement"),
    )
    return c.select(F.lit("customer").alias("file"), F.col("c_custkey").alias("line"), F.to_json(row).alias("value"))


def slice_faults(spark: SparkSession, d: str) -> DataFrame:
    return slices.faults(_slice(spark, d)).select("line", "reason")


def slice_edges(spark: SparkSession, d: str) -> DataFrame:
    return slices.edges(slices.read_rows(_slice(spark, d)))


def _reach_sql(start: str, step: str, lens: str = "") -> str:
    where = f"WHERE lens = '{lens}'" if lens else ""
    return f"""WITH RECURSIVE {E}, {N}, pairs AS (SELECT DISTINCT src, dst FROM edges {where}),
        found(source, node) AS (SELECT name, name FROM names WHERE {start} UNION SELECT f.source, {step})"""


QUERIES = {f.__name__: f for f in (walls, citations_by_lens, foundations_all, impact_all, bridge_centrality, why_path, honesty, theory_sizes, cross_citations, cyclic_reach, orphans, slice_faults, slice_edges)}

DOWN = "p.dst FROM found f JOIN pairs p ON f.node = p.src"
UP = "p.src FROM found f JOIN pairs p ON f.node = p.dst"
SQL = {
    "walls": f"""WITH {E}, {N}, c AS (SELECT dst AS name, count(DISTINCT src) AS citations FROM edges GROUP BY dst)
        SELECT name, citations FROM c JOIN names USING (name) ORDER BY citations DESC, name LIMIT 20""",
    "citations_by_lens": f"""WITH {E}, {N}, lenses AS (SELECT unnest(['statement', 'proof', 'both']) AS lens), c AS (SELECT l.lens, dst AS name, count(DISTINCT src) AS citations FROM lenses l JOIN edges e ON l.lens = 'both' OR l.lens = e.lens GROUP BY 1, 2)
        SELECT l.lens, n.name, coalesce(citations, 0) AS citations FROM lenses l CROSS JOIN names n LEFT JOIN c ON c.lens = l.lens AND c.name = n.name""",
    "foundations_all": _reach_sql("true", DOWN) + " SELECT source, count(*) AS n, min(node) AS first_node FROM found WHERE node <> source GROUP BY source",
    "impact_all": _reach_sql("true", UP, "proof") + " SELECT source, split_part(node, ':', 1) AS kind, count(*) AS n FROM found WHERE node <> source GROUP BY 1, 2",
    "bridge_centrality": _reach_sql("true", UP) + " SELECT source, count(*) - 1 AS n FROM found GROUP BY source",
    "why_path": f"""WITH RECURSIVE {E}, {N}, pairs AS (SELECT DISTINCT src, dst FROM edges),
        found(source, node, path) AS (SELECT name, name, [name] FROM names UNION ALL SELECT f.source, p.dst, list_append(f.path, p.dst) FROM found f JOIN pairs p ON f.node = p.src),
        short AS (SELECT *, rank() OVER (PARTITION BY source, node ORDER BY len(path)) AS r FROM found WHERE node LIKE 'region:%')
        SELECT source, node AS target, array_to_string(min(path), '>') AS path FROM short WHERE r = 1 GROUP BY source, node""",
    "honesty": _reach_sql("name IN ('region:3', 'region:4', 'nation:7')", UP, "proof") + " SELECT DISTINCT node AS name FROM found WHERE node <> source OR node IN ('region:3', 'region:4')",
    "theory_sizes": f"WITH {derived.SQL['decls']} SELECT split_part(module, '.', 2) AS theory, count(*) AS n, count(stmt) AS encoded FROM decls GROUP BY 1",
    "cross_citations": f"""WITH {E}, {N}, t AS (SELECT name, split_part(module, '.', 2) AS theory FROM names)
        SELECT least(a.theory, b.theory) AS left, greatest(a.theory, b.theory) AS right, count(*) AS n FROM edges JOIN t a ON src = a.name JOIN t b ON dst = b.name WHERE a.theory <> b.theory GROUP BY 1, 2""",
    "cyclic_reach": f"""WITH RECURSIVE {derived.SQL['traces']}, pairs AS (SELECT DISTINCT a.method AS src, b.method AS dst FROM traces a JOIN traces b ON a.problem = b.problem AND b.step = a.step + 1),
        found(source, node) AS (SELECT DISTINCT method, method FROM traces UNION SELECT f.source, p.dst FROM found f JOIN pairs p ON f.node = p.src) SELECT source, node FROM found WHERE node <> source""",
    "slice_faults": "SELECT c_custkey AS line, 'kind, module or is_instance is missing' AS reason FROM customer WHERE c_custkey % 10 = 0",
    "slice_edges": "SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'statement' AS lens FROM customer WHERE c_custkey % 10 <> 0",
    "orphans": "SELECT 'nation:' || n_nationkey AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
}
