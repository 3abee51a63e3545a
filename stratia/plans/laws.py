"""Logical edges over laws derived from orders: a customer's segment gives a priority, regions are equivalent to letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.functions import terms
from stratia.operators import hypotheses, logical
from stratia.operators import statements as st
from stratia.session import materialize
from stratia.sources import derived, slices


def _const(c: Column) -> Column:
    return F.concat(F.lit("c("), F.octet_length(c).cast("string"), F.lit(":"), c, F.lit(",0)"))


def _laws(spark: SparkSession, d: str) -> DataFrame:
    """Nations: theorem segment-of-first-letter -> region; parts: a premise, a constant conclusion, or a variable head."""
    n = derived.table(spark, d, "nation").join(derived.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    iff = n.select(F.col("n_nationkey").cast("long").alias("seq"), derived.node("nation", "n_nationkey").alias("name"), F.lit("theorem").alias("kind"), F.lit("Law").alias("module"),
                   F.concat(F.lit("x-stmt-v1;a(a(c(3:Iff,0),a("), _const(F.col("r_name")), F.lit(",n1)),a("), _const(F.concat(F.lit("letter_"), F.substring("n_name", -1, 1))), F.lit(",n2))")).alias("stmt"))
    p = derived.table(spark, d, "part")
    premise = F.when(F.col("p_size") % 7 == 0, F.lit("a(b0,n1)")).otherwise(F.concat(F.lit("a("), _const(F.col("p_brand")), F.lit(",n1)")))
    kind = F.when(F.col("p_size") % 3 == 0, "axiom").otherwise("theorem")
    implies = p.select((F.col("p_partkey") + 1000).alias("seq"), derived.node("part", "p_partkey").alias("name"), kind.alias("kind"), F.lit("Law").alias("module"), F.concat(F.lit("x-stmt-v1;pd("), premise, F.lit(",a("), _const(F.col("p_type")), F.lit(",n2))")).alias("stmt"))
    facts = p.filter("p_size > 20").select((F.col("p_partkey") + 10_000_000).alias("seq"), derived.node("fact", "p_partkey").alias("name"), F.lit("theorem").alias("kind"), F.lit("Law").alias("module"), F.concat(F.lit("x-stmt-v1;a("), _const(F.col("p_brand")), F.lit(",n1)")).alias("stmt"))
    return st.parse(iff.union(implies).union(facts))


def logical_stats(spark: SparkSession, d: str) -> DataFrame:
    return logical.stats(_laws(spark, d))


def logical_edges(spark: SparkSession, d: str) -> DataFrame:
    return logical.edges(_laws(spark, d)).drop("seq")


def busiest_heads(spark: SparkSession, d: str) -> DataFrame:
    return logical.busiest(logical.edges(_laws(spark, d)))


def relationship_survey(spark: SparkSession, d: str) -> DataFrame:
    """What the laws yield, and the classes of the laws with binders at each level."""
    laws, bound = materialize(_laws(spark, d), "laws"), _bound(spark, d)
    degrees = logical.busiest(logical.edges(laws), 1 << 30)
    return logical.survey(logical.stats(laws), degrees, {level: st.classes(st.erased(bound, level)) for level in terms.LEVELS[:-1]})


def relation_paths(spark: SparkSession, d: str) -> DataFrame:
    found = logical.edges(_laws(spark, d))
    heads = logical.from_heads(found).select(F.col("l").alias("source")).distinct()
    return logical.paths(found, heads).select("source", "target", F.array_join("path", ">").alias("path"))


def _bound(spark: SparkSession, d: str) -> DataFrame:
    return materialize(st.parse(derived.binder_laws(spark, d)), "laws")


def binder_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each law at all levels of erasure, which all differ."""
    p = _bound(spark, d)
    out = p.select("name", F.col("root").alias("exact"))
    for level in terms.LEVELS[1:]:
        out = out.join(st.erased(p, level).select("name", F.col("erased").alias(level)), "name")
    return out


def binder_ladder(spark: SparkSession, d: str) -> DataFrame:
    return st.ladder(_bound(spark, d))


def binder_requires(spark: SparkSession, d: str) -> DataFrame:
    return _bound(spark, d).select(F.explode("requires").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def binder_telescopes(spark: SparkSession, d: str) -> DataFrame:
    binders, ends = hypotheses.telescopes(derived.binder_laws(spark, d))
    return binders.join(ends, "name")


def anchored_classes(spark: SparkSession, d: str) -> DataFrame:
    """Laws by what they conclude alone, without instances."""
    return st.classes(st.erased(_bound(spark, d), "instances", of="concludes"))


def explicit_conclusions(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions without the arguments that Rel takes implicitly or by instance, and how many laws have each."""
    return st.explicit(_bound(spark, d), of="concludes").groupBy("explicit").agg(F.count("*").alias("n"))


def qualified_laws(spark: SparkSession, d: str) -> DataFrame:
    """The laws as a slice whose names all go under a namespace, inside statements too."""
    none = F.array().cast("array<string>")
    rows = derived.binder_laws(spark, d).select("*", F.when(F.col("name") != "Rel", F.array(F.lit("Rel"))).otherwise(none).alias("uses_statement"), none.alias("uses_proof"))
    return slices.qualify(rows, "B", F.lit(True)).select("name", "stmt", F.array_join("uses_statement", ",").alias("uses"))


QUERIES = {f.__name__: f for f in (qualified_laws, binder_levels, binder_ladder, binder_requires, binder_telescopes, anchored_classes, explicit_conclusions, logical_stats, logical_edges, busiest_heads, relationship_survey, relation_paths)}

LAWS = """heads AS (SELECT DISTINCT p_brand AS h FROM part WHERE p_size > 20 UNION SELECT DISTINCT p_type FROM part),
    rows AS (SELECT 'nation:' || n_nationkey AS theorem, false AS asserted, 'iff' AS form, r_name || '/1' AS l, 'letter_' || right(n_name, 1) || '/1' AS r, 'edge' AS what FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'part:' || p_partkey, p_size % 3 = 0, 'implies', CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand || '/1' END, p_type || '/1', CASE WHEN p_size % 7 = 0 THEN 'flex' WHEN p_brand NOT IN (SELECT h FROM heads) THEN 'non-prop' ELSE 'edge' END FROM part
        UNION ALL SELECT 'fact:' || p_partkey, false, 'none', NULL, NULL, 'none' FROM part WHERE p_size > 20),
    edges AS (SELECT theorem, asserted, form, l, r FROM rows WHERE what = 'edge')"""
B = derived.SQL["laws"]
LADDER = ", ".join(f"c_{x} AS (SELECT {x}, count(*) AS n FROM levels GROUP BY {x})" for x in terms.LEVELS[:-1])
SQL = {
    "qualified_laws": f"WITH {B} SELECT 'B.' || name AS name, 'x-stmt-v1;' || replace(exact, 'c(3:Rel,0)', 'c(5:B.Rel,0)') AS stmt, CASE WHEN name = 'Rel' THEN '' ELSE 'B.Rel' END AS uses FROM levels",
    "binder_levels": f"WITH {B} SELECT name, exact, presentation, instances, carriers, shape FROM levels",
    "binder_ladder": f"WITH {B}, {LADDER} SELECT name, a.n - 1 AS exact, b.n - a.n AS presentation, c.n - b.n AS instances, d.n - c.n AS carriers FROM levels JOIN c_exact a USING (exact) JOIN c_presentation b USING (presentation) JOIN c_instances c USING (instances) JOIN c_carriers d USING (carriers)",
    "binder_requires": f"WITH {B} SELECT class, count(*) AS n FROM levels GROUP BY class",
    "binder_telescopes": f"WITH {B} SELECT name, class, 0 AS carrier, CASE WHEN name = 'Rel' THEN NULL ELSE 'Rel' END AS concludes FROM levels",
    "anchored_classes": f"""WITH {B}, c AS (SELECT seq, name, 'a(a(a(c(3:Rel,0),' || carrier || '),_),n' || x || ')' AS erased FROM laws)
        SELECT erased, count(*) AS n, arg_min(name, seq) AS first, CAST(sum(CAST(('0x' || substr(md5(name), 1, 6)) AS BIGINT)) AS BIGINT) AS members FROM c GROUP BY 1 HAVING count(*) > 1""",
    "explicit_conclusions": f"WITH {B} SELECT 'a(c(3:Rel,0),n' || x || ')' AS explicit, count(*) AS n FROM laws GROUP BY 1 UNION ALL SELECT 's(0)', 1",
    "logical_stats": f"""WITH {LAWS} SELECT count(*) FILTER (NOT asserted) AS theorems_scanned, count(*) FILTER (asserted) AS axioms_scanned, count(*) FILTER (form = 'iff' AND what = 'edge') AS iff_edges, count(*) FILTER (form = 'implies' AND what = 'edge') AS implication_edges,
        count(*) FILTER (what = 'flex') AS flex_head_sides, 0 AS same_head_sides, count(*) FILTER (what = 'non-prop') AS non_prop_sides, (SELECT count(*) + 1 FROM heads) AS prop_heads FROM rows""",
    "logical_edges": f"WITH {LAWS} SELECT * FROM edges",
    "busiest_heads": f"WITH {LAWS}, e AS (SELECT l AS head FROM edges UNION ALL SELECT r FROM edges) SELECT head, count(*) AS n FROM e GROUP BY head ORDER BY n DESC, head LIMIT 20",
    "relationship_survey": f"""WITH {B}, {LAWS}, s AS (SELECT count(*) FILTER (NOT asserted) AS theorems_scanned, count(*) FILTER (asserted) AS axioms_scanned, count(*) FILTER (form = 'iff' AND what = 'edge') AS iff_edges, count(*) FILTER (form = 'implies' AND what = 'edge') AS implication_edges,
        count(*) FILTER (what = 'flex') AS flex_head_sides, 0::BIGINT AS same_head_sides, count(*) FILTER (what = 'non-prop') AS non_prop_sides, (SELECT count(*) + 1 FROM heads) AS prop_heads FROM rows),
        g AS (SELECT count(*) AS n FROM (SELECT l AS head FROM edges UNION ALL SELECT r FROM edges) GROUP BY head)
        SELECT measure, n FROM (UNPIVOT s ON COLUMNS(*) INTO NAME measure VALUE n) UNION ALL SELECT 'heads', count(*) FROM g UNION ALL SELECT 'hubs', count(*) FROM g WHERE n >= 10 UNION ALL SELECT 'busiest', max(n) FROM g
        UNION ALL """ + " UNION ALL ".join(f"SELECT unnest(['classes_{x}', 'members_{x}']), unnest([count(*), CAST(coalesce(sum(n), 0) AS BIGINT)]) FROM (SELECT count(*) AS n FROM levels GROUP BY {x} HAVING count(*) > 1)" for x in terms.LEVELS[:-1]),
    "relation_paths": f"""WITH RECURSIVE {LAWS}, pairs AS (SELECT DISTINCT l AS src, r AS dst FROM edges WHERE NOT asserted UNION SELECT r, l FROM edges WHERE NOT asserted AND form = 'iff'),
        sources AS (SELECT DISTINCT l AS s FROM edges UNION SELECT r FROM edges WHERE form = 'iff'),
        found(source, node, path) AS (SELECT s, s, [s] FROM sources UNION ALL SELECT f.source, p.dst, list_append(f.path, p.dst) FROM found f JOIN pairs p ON f.node = p.src WHERE NOT list_contains(f.path, p.dst) AND len(f.path) < 8),
        short AS (SELECT *, rank() OVER (PARTITION BY source, node ORDER BY len(path)) AS k FROM found) SELECT source, node AS target, array_to_string(min(path), '>') AS path FROM short WHERE k = 1 GROUP BY source, node""",
}
