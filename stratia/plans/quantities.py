"""Dimensions of laws about quantities: their equations, what follows from what, and the solved form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import dimensions as dim
from stratia.session import materialize
from stratia.sources import derived


def _solved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return dim.solve(dim.constraints(derived.quantity_laws(spark, d)))


def dimension_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = dim.equations(derived.quantity_laws(spark, d))
    return rows.select("name", "row", "atom", "local", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den"))


def dimension_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What each law says without its own variables."""
    rows = dim.constraints(derived.quantity_laws(spark, d)).select("name", "row", F.explode("entries").alias("e"))
    return rows.select("name", "row", "e.atom", F.col("e.v").cast("long").alias("v"))


def dimension_ranks(spark: SparkSession, d: str) -> DataFrame:
    """How many equations are independent of those before them, and how many follow."""
    return _solved(spark, d)[0].groupBy("verdict").agg(F.count("*").alias("n"))


def dimension_reduced(spark: SparkSession, d: str) -> DataFrame:
    reduced = _solved(spark, d)[1]
    return reduced.select("pivot", "atom", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den"))


def dimension_implied(spark: SparkSession, d: str) -> DataFrame:
    """Laws of which every second has another power of its brand, against the solved form of all laws as they are."""
    reduced = materialize(_solved(spark, d)[1], "reduced")
    asked = dim.constraints(derived.quantity_laws(spark, d, off=F.col("p_partkey") % 2))
    return dim.implied(asked, reduced).select("name", "row", "implied")


QUERIES = {f.__name__: f for f in (dimension_rows, dimension_constraints, dimension_ranks, dimension_reduced, dimension_implied)}

Q = derived.SQL["quantities"]
#: Quantities that laws connect, with their weights; all of one part are multiples of its last.
PARTS = f"""{Q}, edges AS (SELECT DISTINCT b AS u, t AS v FROM quantities UNION SELECT DISTINCT t, b FROM quantities),
    weights AS (SELECT DISTINCT b AS u, wb AS w FROM quantities UNION SELECT DISTINCT t, wt FROM quantities),
    reach AS (SELECT u, u AS v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
    parts AS (SELECT u, max(v) AS last FROM reach GROUP BY u)"""
SQL = {
    "dimension_rows": f"""WITH {Q} SELECT name, 0 AS row, b AS atom, false AS local, wt AS num, 1 AS den FROM quantities UNION ALL SELECT name, 0, t, false, -wb, 1 FROM quantities
        UNION ALL SELECT name, 1, b, false, wt, 1 FROM quantities UNION ALL SELECT name, 1, 'b0', true, 1, 1 FROM quantities UNION ALL SELECT name, 1, 'b1', true, -1, 1 FROM quantities""",
    "dimension_constraints": f"WITH {Q} SELECT name, 0 AS row, b AS atom, CASE WHEN b < t THEN 1 ELSE -1 END * (wt // gcd(wt, wb)) AS v FROM quantities UNION ALL SELECT name, 0, t, CASE WHEN b < t THEN -1 ELSE 1 END * (wb // gcd(wt, wb)) FROM quantities",
    "dimension_ranks": f"""WITH RECURSIVE {PARTS}, r AS (SELECT count(*) - count(DISTINCT last) AS n FROM parts)
        SELECT 'independent' AS verdict, n FROM r UNION ALL SELECT 'implied', (SELECT count(*) FROM quantities) - n FROM r""",
    "dimension_reduced": f"""WITH RECURSIVE {PARTS}, p AS (SELECT u AS head, last, a.w AS w, b.w AS l FROM parts JOIN weights a USING (u) JOIN weights b ON b.u = last WHERE parts.u <> last)
        SELECT head AS "pivot", head AS atom, 1 AS num, 1 AS den FROM p UNION ALL SELECT head, last, -(w // gcd(w, l)), l // gcd(w, l) FROM p""",
    "dimension_implied": f"WITH {Q} SELECT name, 0 AS row, seq % 2 = 0 AS implied FROM quantities",
}
