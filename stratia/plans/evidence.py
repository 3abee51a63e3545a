"""Hypotheses, proofs elsewhere, families and rates over the derived corpus.

For hypotheses a lattice of classes stands over nations: N<nation> lies under R<region> and G<nation mod 4>, those under Top.
An order asks for its customer's nation class and uses its suppliers, each of which asks for one class of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.functions.components import connected_components
from stratia.operators import hypotheses as hy
from stratia.operators import statements as st
from stratia.plans import statements as plans
from stratia.session import materialize
from stratia.sources import derived

D = derived.SQL["decls"]


def _class(letter: str, key: Column) -> Column:
    return F.concat(F.lit(letter), key.cast("string"))


def _lattice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(binders, ends, uses) of orders, suppliers and the projections between classes."""
    t = lambda name: derived.table(spark, d, name)
    nation = t("nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    level = {"N": _class("N", F.col("n")), "R": _class("R", F.col("r")), "G": _class("G", F.col("n") % 4), "Top": F.lit("Top")}
    ups = None
    for low, high in (("N", "R"), ("N", "G"), ("R", "Top"), ("G", "Top")):
        one = nation.select(F.concat(level[low], F.lit(".to"), level[high]).alias("name"), level[low].alias("class"), level[high].alias("concludes")).distinct()
        ups = one if ups is None else ups.union(one)
    makers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n"))
    asked = F.element_at(F.array(*level.values()), (F.col("s_suppkey") % 4 + 1).cast("int"))
    homes = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n"))
    orders = homes.select(derived.node("order", "o_orderkey").alias("name"), level["N"].alias("class"), F.col("o_orderkey").alias("k"), F.concat(level["N"], F.lit(".to"), level["R"]).alias("up"))
    row = lambda df, name, cls, at: df.select(name, cls.alias("class"), F.lit(at).alias("carrier"))
    binders = row(ups, "name", F.col("class"), 0).union(row(orders, "name", F.col("class"), 0)).union(row(orders.filter("k % 10 = 7"), "name", F.lit("Top"), 1))
    binders = binders.union(row(makers, derived.node("supplier", "s_suppkey").alias("name"), asked, 0))
    ends = ups.select("name", "concludes").union(orders.filter("k % 10 = 3").select("name", F.lit("Top")))
    items = t("lineitem").select(derived.node("order", "l_orderkey").alias("name"), derived.node("supplier", "l_suppkey").alias("used"), F.lit("proof").alias("lens"))
    # Written once: what follows reads each several times.
    return materialize(binders, "binders"), materialize(ends, "ends"), materialize(items.union(orders.select("name", "up", F.lit("statement"))), "uses")


def hypothesis_homes(spark: SparkSession, d: str) -> DataFrame:
    return hy.homes(*_lattice(spark, d))


def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    binders, ends, _ = _lattice(spark, d)
    return hy.ancestors(binders, ends)


def proved_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    return hy.proved_elsewhere(st.erased(plans._parsed(spark, d), "shape"))


def proof_families(spark: SparkSession, d: str) -> DataFrame:
    shapes = st.erased(plans._parsed(spark, d), "shape").select(F.col("name").alias("used"), F.col("erased").alias("shape"))
    uses = derived.edges(spark, d).filter("src like 'order:%' and dst like 'part:%'").select(F.col("src").alias("name"), F.col("dst").alias("used"))
    return hy.proof_families(uses, shapes).select("family", "n", "first", F.array_join("shapes", ";").alias("shapes"))


def _substitutions(spark: SparkSession, d: str) -> DataFrame:
    firsts = materialize(st.collapsed(derived.declarations(spark, d)), "collapsed")
    return hy.substitutions(plans._variants(firsts), firsts.select("name", "rigid"))


def substitutions(spark: SparkSession, d: str) -> DataFrame:
    return _substitutions(spark, d)


def interchangeable(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_substitutions(spark, d)).select(F.col("node").alias("sym"), F.col("root").alias("component"))


def shrunk_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.declarations(spark, d).select(F.col("module").alias("family"), (F.col("kind") == "theorem").alias("hit"))
    return hy.shrunk_rates(rows).withColumn("rate", F.round("rate", 9))


def auc(spark: SparkSession, d: str) -> DataFrame:
    part = derived.table(spark, d, "part")
    rows = part.select(F.col("p_brand").alias("family"), F.floor(F.col("p_retailprice") / 10).alias("score"), (F.col("p_size") % 3 == 0).alias("positive"))
    return hy.auc(rows).withColumn("auc", F.round("auc", 9))


def information(spark: SparkSession, d: str) -> DataFrame:
    """Over all sources and keys: classes are compared once, and a class counts as often as it has other members."""
    p, n = plans._parsed(spark, d), plans._total(spark, d)
    rows = st.erased(p, "shape", "shape").withColumn("erased", F.col("root"))
    reps = materialize(st.representatives(rows), "representatives")
    keys = materialize(st.weighed(st.sources(reps), reps, n), "weighed")
    found = st.information_by_class(keys, reps, st.symbol_frequency(p), n)
    best = [F.round(f"best_{m}", 6).alias(f"best_{m}") for m in ("info_weighted", "info_dice")]
    mean = [F.round(F.col(f"sum_{m}") / F.col("n"), 6).alias(f"mean_{m}") for m in ("info_weighted", "info_dice")]
    of_class = materialize(found.select("class", *best, *mean, "n"), "information")
    return st.members(rows, reps).join(of_class, "class").drop("class")


QUERIES = {f.__name__: f for f in (hypothesis_homes, class_ancestors, proved_elsewhere, proof_families, substitutions, interchangeable, shrunk_rates, auc, information)}

EDITS = f"""{D}, v AS (SELECT a.size, a.bucket, CASE WHEN a.brand <> b.brand THEN a.brand ELSE a.type END AS a, CASE WHEN a.brand <> b.brand THEN b.brand ELSE b.type END AS b
        FROM decls a JOIN decls b ON a.size = b.size AND a.bucket = b.bucket AND (a.brand <> b.brand)::INT + (a.type <> b.type)::INT = 1),
    subs AS (SELECT a, b, count(DISTINCT (size, bucket)) AS skeletons, count(*) AS pairs FROM v GROUP BY 1, 2 HAVING count(DISTINCT (size, bucket)) >= 2)"""

SQL = {
    "hypothesis_homes": """WITH sup AS (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        o AS (SELECT o_orderkey AS k, c_nationkey AS n, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
        x AS (SELECT k, o.n, o.r, bool_or(l_suppkey % 4 = 0 AND sup.n = o.n) AS own, bool_or(l_suppkey % 4 = 1 AND sup.r = o.r) AS region, bool_or(l_suppkey % 4 = 2 AND sup.n % 4 = o.n % 4) AS part, bool_or(l_suppkey % 4 = 3) AS top
            FROM o LEFT JOIN lineitem ON l_orderkey = k LEFT JOIN sup ON s_suppkey = l_suppkey GROUP BY ALL)
        SELECT 'order:' || k AS name, CASE WHEN k % 10 NOT IN (3, 7) THEN 'N' || n END AS class, CASE WHEN k % 10 = 7 THEN 'multi-carrier' WHEN k % 10 = 3 THEN 'produces-a-class' WHEN own THEN 'at-home'
            WHEN region AND part THEN 'no-single-home' WHEN region OR part OR top THEN 'over-hypothesis' ELSE 'unused' END AS verdict,
            CASE WHEN k % 10 IN (3, 7) OR own OR (region AND part) THEN NULL WHEN region THEN 'R' || r WHEN part THEN 'G' || n % 4 WHEN top THEN 'Top' END AS home, false AS projection FROM x
        UNION ALL SELECT 'supplier:' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'N' || n WHEN 1 THEN 'R' || r WHEN 2 THEN 'G' || n % 4 ELSE 'Top' END, 'unused', NULL, false FROM sup
        UNION ALL SELECT DISTINCT unnest(['N' || n_nationkey || '.toR' || n_regionkey, 'N' || n_nationkey || '.toG' || n_nationkey % 4, 'R' || n_regionkey || '.toTop', 'G' || n_nationkey % 4 || '.toTop']), NULL, 'produces-a-class', NULL, false FROM nation""",
    "class_ancestors": """WITH e AS (SELECT 'N' || n_nationkey AS class, unnest(['R' || n_regionkey, 'G' || n_nationkey % 4]) AS above FROM nation)
        SELECT class, above FROM e UNION SELECT class, 'Top' FROM e UNION SELECT above, 'Top' FROM e""",
    "proved_elsewhere": f"""WITH {D}, p AS (SELECT layers, count(*) AS proofs, arg_min(name, seq) AS proof FROM decls WHERE kind = 'theorem' GROUP BY 1)
        SELECT name, proofs, proof FROM decls JOIN p USING (layers) WHERE kind = 'axiom'""",
    "proof_families": f"""WITH {D}, u AS (SELECT DISTINCT l_orderkey AS k, 'part:' || l_partkey AS used FROM lineitem), c AS (SELECT k, {plans.SHAPE} || ' x ' || count(*) AS s, count(*) AS n FROM u JOIN decls ON name = used GROUP BY k, layers),
        m AS (SELECT 'order:' || k AS name, list_sort(list(s)) AS parts FROM c GROUP BY k HAVING sum(n) >= 2)
        SELECT sha256(array_to_string(parts, chr(10))) AS family, count(*) AS n, min(name) AS first, array_to_string(any_value(parts), ';') AS shapes FROM m GROUP BY parts""",
    "substitutions": f"WITH {EDITS} SELECT * FROM subs",
    "interchangeable": f"""WITH RECURSIVE {EDITS}, r AS (SELECT a, b FROM subs UNION SELECT r.a, s.b FROM r JOIN subs s ON s.a = r.b)
        SELECT a AS sym, least(a, min(b)) AS component FROM r GROUP BY a""",
    "shrunk_rates": f"""WITH {D}, f AS (SELECT module AS family, count(*) AS n, count(*) FILTER (kind = 'theorem') AS hits FROM decls GROUP BY 1), w AS (SELECT sum(hits) * 1.0 / sum(n) AS base FROM f)
        SELECT family, n, hits, round((hits + 5.0 * base) / (n + 5.0), 9) AS rate FROM f, w""",
    "auc": """WITH s AS (SELECT p_brand AS family, floor(p_retailprice / 10) AS score, count(*) FILTER (p_size % 3 = 0) AS p, count(*) FILTER (p_size % 3 <> 0) AS q FROM part GROUP BY 1, 2),
        b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY family ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT family, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, CASE WHEN sum(p) * sum(q) > 0 THEN round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 9) END AS auc FROM b GROUP BY family""",
    "information": plans.SIMILAR + """, syms AS (SELECT name, unnest([brand, type]) AS sym FROM decls), df AS (SELECT sym, count(DISTINCT name) AS df FROM syms GROUP BY 1), lone AS (SELECT count(*) FILTER (layers > 0) AS fs FROM decls),
        w AS (SELECT d.name, d.brand, d.type, layers, greatest(ln(t.total * 1.0 / greatest(l.fs, 1)), 0) AS wf, ln(t.total * 1.0 / b.df) AS wb, ln(t.total * 1.0 / k.df) AS wt FROM decls d, total t, lone l, df b, df k WHERE b.sym = d.brand AND k.sym = d.type),
        g AS (SELECT a.name, least(a.layers, b.layers) * a.wf + CASE WHEN a.layers = b.layers THEN (a.brand = b.brand)::INT * a.wb + (a.type = b.type)::INT * a.wt ELSE 0 END AS s,
            a.layers * a.wf + a.wb + a.wt AS x, b.layers * b.wf + b.wb + b.wt AS y FROM pairs p JOIN w a ON a.name = p.name JOIN w b ON b.name = p.other),
        r AS (SELECT name, CASE WHEN greatest(x, y) > 0 THEN s / greatest(x, y) ELSE 0 END AS i, CASE WHEN x + y > 0 THEN 2 * s / (x + y) ELSE 0 END AS d FROM g)
        SELECT name, count(*) AS n, round(max(i), 6) AS best_info_weighted, round(avg(i), 6) AS mean_info_weighted, round(max(d), 6) AS best_info_dice, round(avg(d), 6) AS mean_info_dice FROM r GROUP BY name""",
}
