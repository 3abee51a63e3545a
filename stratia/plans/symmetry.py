"""Motifs of symmetry over laws of parts, suppliers and orders, their families, and who cites whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import symmetry as sy
from stratia.session import materialize
from stratia.sources import derived


def symmetry_motifs(spark: SparkSession, d: str) -> DataFrame:
    return sy.motifs(derived.symmetry_laws(spark, d))


def motif_families(spark: SparkSession, d: str) -> DataFrame:
    laws = derived.symmetry_laws(spark, d)
    return sy.families(sy.motifs(laws), laws).withColumn("expected", F.round("expected", 6))


def motif_citations(spark: SparkSession, d: str) -> DataFrame:
    """Whether laws of invariance cite laws of exchange."""
    laws = derived.symmetry_laws(spark, d)
    found = materialize(sy.motifs(laws).select("name", "motif"), "motifs")
    out = sy.citations(derived.edges(spark, d), laws, found.filter("motif = 'INV'"), found.filter("motif = 'SWAP'"))
    return out.select("hops", "null", "observed", "back", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (symmetry_motifs, motif_families, motif_citations)}

Y, E = derived.SQL["symmetries"], derived.SQL["edges"]
SQL = {
    "symmetry_motifs": f"WITH {Y} SELECT * EXCLUDE module FROM hits",
    "motif_families": f"""WITH {Y}, sizes AS (SELECT module, count(*) AS s FROM symmetries GROUP BY 1), total AS (SELECT sum(s) AS t FROM sizes),
        f AS (SELECT motif, context, count(*) AS n, min(name) AS first, count(DISTINCT module) AS modules FROM hits WHERE context IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT f.*, round(sum(CASE WHEN t - s < n THEN 1 ELSE 1 - exp(lgamma(t - s + 1) - lgamma(t - s - n + 1) - lgamma(t + 1) + lgamma(t - n + 1)) END), 6) AS expected FROM f, sizes, total GROUP BY ALL""",
    "motif_citations": f"""WITH {Y}, {E}, one AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT name FROM symmetries) AND dst IN (SELECT name FROM symmetries)),
        two AS MATERIALIZED (SELECT src, dst FROM one UNION SELECT a.src, b.dst FROM one a JOIN one b ON a.dst = b.src WHERE a.src <> b.dst),
        graph AS (SELECT 1 AS hops, src, dst FROM one UNION ALL SELECT 2, src, dst FROM two),
        k AS (SELECT name, form = 0 AS a, form = 1 AS b, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM symmetries LEFT JOIN (SELECT src AS name, count(*) AS o FROM one GROUP BY 1) USING (name) LEFT JOIN (SELECT dst AS name, count(*) AS i FROM one GROUP BY 1) USING (name)),
        n AS (SELECT name, label, nul, CASE WHEN nul = 'uniform' THEN 0 WHEN v = 0 THEN 0 ELSE least(12, length(bin(v))) END AS bucket, member
            FROM (SELECT name, 'a' AS label, o AS v, a AS member FROM k UNION ALL SELECT name, 'b', i, b FROM k), (VALUES ('uniform'), ('matched')) u(nul)),
        want AS (SELECT label, nul, bucket, count(*) FILTER (member) AS k FROM n GROUP BY ALL),
        taken AS MATERIALIZED (SELECT name, label, nul, draw FROM (SELECT *, row_number() OVER (PARTITION BY label, nul, draw, bucket ORDER BY md5('{sy.SEED}:' || label || ':' || draw || ':' || name)) AS place FROM n, range({sy.DRAWS}) r(draw)) JOIN want USING (label, nul, bucket) WHERE place <= k),
        null_ AS (SELECT hops, nul, draw, count(x.name) AS c FROM (SELECT DISTINCT hops FROM graph), (VALUES ('uniform'), ('matched')) u(nul), range({sy.DRAWS}) r(draw)
            LEFT JOIN (SELECT g.hops AS h, a.nul AS n, a.draw AS d, a.name FROM graph g JOIN taken a ON a.name = g.src AND a.label = 'a' JOIN taken b ON b.name = g.dst AND b.label = 'b' AND b.nul = a.nul AND b.draw = a.draw) x ON x.h = hops AND x.n = nul AND x.d = draw GROUP BY ALL),
        seen AS (SELECT hops, count(*) FILTER (s.a AND t.b) AS observed, count(*) FILTER (s.b AND t.a) AS back FROM graph JOIN k s ON s.name = src JOIN k t ON t.name = dst GROUP BY hops)
        SELECT hops, nul AS null, observed, back, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd, round((observed - avg(c)) / nullif(stddev_pop(c), 0), 6) AS z, round((count(*) FILTER (c >= observed) + 1) / (count(*) + 1), 6) AS p FROM null_ JOIN seen USING (hops) GROUP BY hops, nul, observed, back""",
}
