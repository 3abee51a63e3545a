"""Ways to a proof over laws with binders: equals at each level, equal conclusions, and more general statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import provability as pr
from stratia.operators import statements as st
from stratia.session import materialize
from stratia.sources import derived


def _laws(spark: SparkSession, d: str) -> DataFrame:
    """Parsed laws, of which those with a key that 3 divides are open."""
    return materialize(st.parse(derived.binder_laws(spark, d)).withColumn("proved", (F.col("seq") > 0) & (F.col("seq") % 3 != 0)), "laws")


def equivalent_proofs(spark: SparkSession, d: str) -> DataFrame:
    return pr.equivalents(_laws(spark, d))


def same_conclusion(spark: SparkSession, d: str) -> DataFrame:
    found = pr.conclusions(_laws(spark, d))
    edits = F.array_join(F.transform("edits", lambda e: F.concat_ws(">", e["s"], e["t"])), ",")
    return found.select("name", "tier", "proofs", "proof", edits.alias("edits"))


def subsumers(spark: SparkSession, d: str) -> DataFrame:
    return pr.subsumers(_laws(spark, d))


QUERIES = {f.__name__: f for f in (equivalent_proofs, same_conclusion, subsumers)}

B = derived.SQL["laws"] + ", pv AS (SELECT 'law:' || c_custkey AS name, c_custkey % 3 <> 0 AS proved FROM customer UNION ALL SELECT 'Rel', false), lv AS (SELECT * FROM levels JOIN pv USING (name)), lw AS (SELECT * FROM laws JOIN pv USING (name))"
LEVEL = """SELECT a.name, '{0}' AS level, count(*) AS proofs, min(b.name) AS proof FROM lv a JOIN lv b ON a.{0} = b.{0} WHERE NOT a.proved AND b.proved GROUP BY a.name"""
SQL = {
    "equivalent_proofs": f"WITH {B} " + " UNION ALL ".join(LEVEL.format(x) for x in pr.LEVELS),
    "same_conclusion": f"""WITH {B}, c AS (SELECT name, proved, carrier, inst, x, carrier = 'b2' AS bound, [CASE WHEN carrier <> 'b2' THEN substr(carrier, 5, 3) END, 'inst' || inst] AS slots FROM lw),
        f AS (SELECT bound, x, count(*) AS proofs, min(name) AS proof, arg_min(slots, name) AS theirs FROM c WHERE proved GROUP BY 1, 2)
        SELECT a.name, 'identical' AS tier, count(*) AS proofs, min(b.name) AS proof, '' AS edits FROM c a JOIN c b USING (carrier, inst, x) WHERE NOT a.proved AND b.proved GROUP BY a.name
        UNION ALL SELECT name, 'same_tree', proofs, proof, array_to_string(list_sort(list_filter(list_transform(range(1, 3), lambda i: CASE WHEN slots[i] <> theirs[i] THEN slots[i] || '>' || theirs[i] END), lambda e: e IS NOT NULL)), ',')
            FROM c JOIN f USING (bound, x) WHERE NOT proved""",
    "subsumers": f"""WITH {B}, n AS (SELECT x, count(*) AS n FROM lw WHERE proved GROUP BY x)
        SELECT a.name, any_value(n) - CAST(any_value(a.proved) AS BIGINT) AS proofs, min(b.name) AS proof FROM lw a JOIN lw b ON a.x = b.x AND a.name <> b.name AND b.proved JOIN n ON n.x = a.x GROUP BY a.name""",
}
