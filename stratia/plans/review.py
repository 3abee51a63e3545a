"""Checks of claims, freezes, links and failures, candidates for weaker hypotheses, ways to a proof, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import claims, selection
from stratia.operators import hypotheses as hy
from stratia.operators import statements as st
from stratia.plans import evidence
from stratia.plans import statements as plans
from stratia.session import materialize
from stratia.sources import derived

PROVENANCE = ("oracle", "formal", "structural", "assertion", "empirical", "numerical", "heuristic", "unclassified", "derived", "candidate")
EVIDENCE = ("theorem", "checked-certificate", "structural", "asserted", "heuristic", "empirical")
KINDS = ("unknown-declaration", "elaboration", "unification", "stale-handle", "stale-environment", "internal")
TEXTS = ("Failed to synthesize Ring", "application Type Mismatch", "unknown identifier x", "missing hypothesis h", "deep recursion", None)
ROLES = ("PROMO", "S*")
#: Relations by number: types of arguments, policy of scope, evidence that counts.
RELATIONS = [(0, ["order", "customer"], "required", ["formal", "structural"]), (1, ["order"], "optional", ["formal"]), (2, ["customer", "order"], "required", ["formal", "empirical", "structural"])]


def _pick(values: tuple, by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def statement_verify(spark: SparkSession, d: str) -> DataFrame:
    """Parts against freezes of which some are of another text, version or form."""
    rows, case = derived.declarations(spark, d), F.col("seq") % 6
    own = F.concat(F.lit("x-stmt-v1:sha256:"), F.sha2("stmt", 256))
    frozen = F.when(case == 1, F.concat(F.lit("x-stmt-v1:sha256:"), F.sha2("name", 256))).when(case == 2, F.concat(F.lit("x-stmt-v0:sha256:"), F.sha2("stmt", 256))).when(case == 3, "x-stmt-v1:md5:00").when(case == 4, "x-stmt-v1:sha256:").otherwise(own)
    encoding = F.when(case == 5, F.concat(F.lit("x-stmt-v2;"), F.substring("stmt", 11, 1 << 20))).otherwise(F.col("stmt"))
    return rows.select("name", claims.verdict(encoding, frozen).alias("verdict"))


def legacy_dispositions(spark: SparkSession, d: str) -> DataFrame:
    o = derived.table(spark, d, "orders")
    inputs = F.when(F.col("o_custkey") % 3 > 0, F.array("o_custkey")).otherwise(F.array().cast("array<bigint>"))
    return o.select("o_orderkey", claims.disposition(_pick(PROVENANCE, F.col("o_orderkey")), F.col("o_orderstatus") == "F", inputs).alias("disposition"))


def claim_violations(spark: SparkSession, d: str) -> DataFrame:
    o = derived.table(spark, d, "orders")
    args = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("order"), F.lit("customer"))).when(F.col("o_custkey") % 3 == 1, F.array(F.lit("order"))).otherwise(F.array(F.lit("customer"), F.lit("order")))
    rows = o.select(
        F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 4).alias("relation"), args.alias("args"), F.when(F.col("o_orderstatus") == "P", "not-applicable").otherwise("complete").alias("scope"),
        F.when(F.col("o_orderpriority").startswith("1"), "empirical").otherwise("formal").alias("evidence"), F.when(F.col("o_custkey") % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.array("o_custkey")).alias("targets"),
    )
    return claims.claim_violations(rows, spark.createDataFrame(RELATIONS, "relation long, arguments array<string>, scope_policy string, admissible array<string>"))


def support_violations(spark: SparkSession, d: str) -> DataFrame:
    """An order is an expression over its lines; parts below a price are no known evidence."""
    t = lambda name: derived.table(spark, d, name)
    tops = t("orders").select(F.col("o_orderkey").alias("expression"), F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), _pick(("all", "any", "at-least", "rule"), F.col("o_orderkey")).alias("op"), (F.col("o_custkey") % 5).cast("int").alias("k"), F.lit(None).cast("long").alias("ref"))
    leaves = t("lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").cast("int"), F.lit(0), F.lit("evidence"), F.lit(None).cast("int"), F.col("l_partkey"))
    known = t("part").filter("p_retailprice >= 950").select(F.col("p_partkey").alias("ref"))
    return claims.support_violations(tops.union(leaves), known)


def artifact_links(spark: SparkSession, d: str) -> DataFrame:
    p = derived.table(spark, d, "part")
    rows = p.select(derived.node("part", "p_partkey").alias("declaration"), _pick((*claims.ARTIFACT_KINDS, "other"), F.col("p_partkey")).alias("kind"), _pick(EVIDENCE, F.col("p_size")).alias("evidence"))
    return claims.artifact_links(rows)


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    e = derived.table(spark, d, "events")
    found = claims.failure_class(_pick(TEXTS, F.col("event_id")), _pick(KINDS, F.col("user_id")), (F.col("event_id") % 17 == 0).cast("int"))
    return e.select(found.alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def excluded_roles(spark: SparkSession, d: str) -> DataFrame:
    p = derived.table(spark, d, "part").select(derived.node("part", "p_partkey").alias("name"), F.concat_ws(".", "p_brand", "p_type").alias("full"))
    return p.filter(claims.excluded_role(F.col("full"), list(ROLES))).select("name")


def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders that name customers who are in no debt, as if those alone were records."""
    o, c = derived.table(spark, d, "orders"), derived.table(spark, d, "customer").filter("c_acctbal >= 0")
    return claims.reference_violations(o, "o_orderkey", "o_custkey", c, "c_custkey")


def hypothesis_candidates(spark: SparkSession, d: str) -> DataFrame:
    return hy.candidates(*evidence._lattice(spark, d))


def _proved(spark: SparkSession, d: str) -> DataFrame:
    """Parsed parts, of which those with an even key count as proved."""
    return materialize(plans._parsed(spark, d).withColumn("proved", F.col("seq") % 2 == 0), "proved")


def provable_routes(spark: SparkSession, d: str) -> DataFrame:
    return hy.routes(_proved(spark, d))


def frontier_distance(spark: SparkSession, d: str) -> DataFrame:
    return hy.frontier_distance(_proved(spark, d))


def similar_brute(spark: SparkSession, d: str) -> DataFrame:
    """Every part whose key 50 divides against all others, without an index."""
    rows = plans._shaped(spark, d)
    found = st.similar_brute(rows, F.col("seq") % 50 == 0)
    return found.select("name", "other", "rank", "common", F.round("retention", 6).alias("retention"))


def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts choose suppliers by what is ordered of them, each supplier taking at most three."""
    items = derived.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    rows = items.select(derived.node("part", "l_partkey").alias("left"), derived.node("supplier", "l_suppkey").alias("right"), "score")
    return selection.select(rows, derived.declarations(spark, d).select(F.col("name").alias("left")), 3)


def best_selection(spark: SparkSession, d: str) -> DataFrame:
    """Of each type and size, parts choose brands that are there, one each: how many get one, and the total score.

    A score is the part's price bucket times the brand's weight, by which the sides' order decides.
    """
    p = derived.table(spark, d, "part").select(derived.node("part", "p_partkey").alias("left"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("team"), F.col("p_brand").alias("brand"), F.floor(F.col("p_retailprice") / 100).cast("long").alias("f"))
    brands = p.select("team", "brand", (F.ascii(F.substring("brand", -1, 1)) % 7 + F.length("brand")).alias("g")).distinct()
    rows = p.select("left", "team", "f").join(brands, "team").select("team", "left", F.concat_ws("/", "team", "brand").alias("right"), (F.col("f") * F.col("g")).alias("score"))
    found = selection.best_selection(rows, p)
    return found.join(p.select("left", "team"), "left").groupBy("team").agg(F.count("right").alias("selected"), F.sum("score").alias("total"), F.count_if(F.col("state") == "unmatched").alias("unmatched"))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 10).alias("y"))
    return hy.spearman(rows).select("family", "n", F.round("rho", 9).alias("rho"))


QUERIES = {f.__name__: f for f in (statement_verify, legacy_dispositions, claim_violations, support_violations, artifact_links, failure_classes, excluded_roles, missing_references, hypothesis_candidates, provable_routes, frontier_distance, similar_brute, selected_pairs, best_selection, spearman)}


def _case(values: tuple, by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def _failures() -> str:
    by_text = " ".join(f"WHEN lower(coalesce(message, '')) LIKE '%{text}%' THEN '{name}'" for text, name in claims.MESSAGES)
    return f"""WITH f AS (SELECT {_case(TEXTS, 'event_id')} AS message, {_case(KINDS, 'user_id')} AS kind, event_id % 17 = 0 AS missing FROM events)
        SELECT CASE WHEN missing THEN 'instance-synthesis' {by_text} WHEN kind LIKE 'stale%' THEN 'stale-context' ELSE kind END AS failure, count(*) AS n FROM f GROUP BY 1"""


D = derived.SQL["decls"]
MATES = f"""{D}, m AS (SELECT a.name, b.name AS other, a.brand AS ab, b.brand AS bb, a.type AS aty, b.type AS bty, (a.brand <> b.brand)::INT + (a.type <> b.type)::INT AS n
    FROM decls a JOIN decls b ON a.size = b.size AND a.bucket = b.bucket WHERE a.seq % 2 = 1 AND b.seq % 2 = 0)"""
SQL = {
    "statement_verify": f"WITH {D} SELECT name, ['match', 'differs', 'stale-freeze', 'malformed-freeze', 'malformed-freeze', 'unknown-version'][seq % 6 + 1] AS verdict FROM decls",
    "legacy_dispositions": f"""WITH f AS (SELECT o_orderkey, {_case(PROVENANCE, 'o_orderkey')} AS p, o_orderstatus = 'F' AS proved, o_custkey % 3 > 0 AS has FROM orders)
        SELECT o_orderkey, CASE WHEN p = 'formal' AND proved THEN 'legacy-unverified-formal' WHEN p = 'derived' AND has THEN 'structural-evidence-candidate' WHEN p = 'derived' THEN 'legacy-unverified-structural'
            WHEN p = 'unclassified' THEN 'legacy-unattributed-assertion' {' '.join(f"WHEN p = '{k}' THEN '{v}'" for k, v in claims.DISPOSITIONS.items())} END AS disposition FROM f""",
    "claim_violations": f"""WITH rel(relation, arguments, policy, admissible) AS (VALUES {', '.join(f"({i}, {a}, '{p}', {e})" for i, a, p, e in RELATIONS)}),
        c AS (SELECT o_orderkey AS claim, o_orderkey % 4 AS relation, CASE o_custkey % 3 WHEN 0 THEN ['order', 'customer'] WHEN 1 THEN ['order'] ELSE ['customer', 'order'] END AS args, o_orderstatus = 'P' AS unscoped, CASE WHEN o_orderpriority LIKE '1%' THEN 'empirical' ELSE 'formal' END AS evidence, o_custkey % 10 = 0 AS bare FROM orders),
        r AS (SELECT claim, c.relation, CASE WHEN arguments IS NULL THEN 'unknown-relation' WHEN len(args) <> len(arguments) THEN 'wrong-arity' WHEN args <> arguments THEN 'wrong-argument-type' WHEN policy = 'required' AND unscoped THEN 'scope-required'
            WHEN NOT list_contains(admissible, evidence) THEN 'evidence-not-allowed' WHEN bare THEN 'no-targets' END AS rule FROM c LEFT JOIN rel ON rel.relation = c.relation) SELECT * FROM r WHERE rule IS NOT NULL""",
    "support_violations": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS expression, 0 AS node, CASE WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_custkey % 5 < 1 OR o_custkey % 5 > coalesce(n, 0) THEN 'threshold' END WHEN coalesce(n, 0) = 0 THEN 'empty' END AS rule FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
        SELECT * FROM t WHERE rule IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'missing' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice >= 950)""",
    "artifact_links": f"""WITH a AS (SELECT 'part:' || p_partkey AS declaration, {_case((*claims.ARTIFACT_KINDS, 'other'), 'p_partkey')} AS kind, {_case(EVIDENCE, 'p_size')} AS evidence FROM part)
        SELECT *, CASE WHEN kind = 'other' THEN 'unknown-kind' WHEN kind = 'reified_as' AND evidence NOT IN ('theorem', 'checked-certificate') THEN 'insufficient-evidence' END AS rule, kind IN ('reified_as', 'refined_into') AND evidence IN ('theorem', 'checked-certificate') AS formal_bridge FROM a""",
    "failure_classes": _failures(),
    "excluded_roles": "SELECT 'part:' || p_partkey AS name FROM part WHERE p_type = 'PROMO' OR p_type LIKE 'S%'",
    "missing_references": "SELECT o_orderkey, o_custkey AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "hypothesis_candidates": """WITH sup AS (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        o AS (SELECT o_orderkey AS k, c_nationkey AS n, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 10 NOT IN (3, 7)),
        x AS (SELECT k, o.n, o.r, coalesce(bool_or(l_suppkey % 4 = 0 AND sup.n = o.n), false) AS own, coalesce(bool_or(l_suppkey % 4 = 1 AND sup.r = o.r), false) AS region, coalesce(bool_or(l_suppkey % 4 = 2 AND sup.n % 4 = o.n % 4), false) AS part
            FROM o LEFT JOIN lineitem ON l_orderkey = k LEFT JOIN sup ON s_suppkey = l_suppkey GROUP BY ALL),
        c AS (SELECT 'order:' || k AS name, 'N' || n AS class, unnest(['N' || n, CASE WHEN NOT own AND NOT part THEN 'R' || r END, CASE WHEN NOT own AND NOT region THEN 'G' || n % 4 END, CASE WHEN NOT own AND NOT region AND NOT part THEN 'Top' END]) AS candidate FROM x
            UNION ALL SELECT 'supplier:' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'N' || n WHEN 1 THEN 'R' || r WHEN 2 THEN 'G' || n % 4 ELSE 'Top' END, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['N' || n, 'R' || r, 'G' || n % 4, 'Top'] WHEN 1 THEN ['R' || r, 'Top'] WHEN 2 THEN ['G' || n % 4, 'Top'] ELSE ['Top'] END) FROM sup)
        SELECT * FROM c WHERE candidate IS NOT NULL""",
    "provable_routes": f"""WITH {MATES}, v AS (SELECT a.size, a.bucket, CASE WHEN a.brand <> b.brand THEN a.brand ELSE a.type END AS a, CASE WHEN a.brand <> b.brand THEN b.brand ELSE b.type END AS b FROM decls a JOIN decls b ON a.size = b.size AND a.bucket = b.bucket AND (a.brand <> b.brand)::INT + (a.type <> b.type)::INT = 1),
        subs AS (SELECT a, b FROM v GROUP BY 1, 2 HAVING count(DISTINCT (size, bucket)) >= 2)
        SELECT name, 'exact' AS route, min(other) AS proof FROM m WHERE n = 0 GROUP BY name
        UNION ALL SELECT name, 'rewrite', min(other) FROM m JOIN subs ON a = CASE WHEN ab <> bb THEN ab ELSE aty END AND b = CASE WHEN ab <> bb THEN bb ELSE bty END WHERE n = 1 GROUP BY name""",
    "frontier_distance": f"WITH {MATES} SELECT name, min(n) AS distance FROM m GROUP BY name",
    "similar_brute": f"""WITH {D}, pairs AS (SELECT a.name, b.name AS other FROM decls a, decls b WHERE a.seq % 50 = 0 AND a.name <> b.name), compared AS ({plans.COMPARE.format(pairs='pairs')})
        SELECT name, other, row_number() OVER w AS rank, common, round(common * 1.0 / whole, 6) AS retention FROM compared WHERE common >= 6 AND common * 1.0 / whole >= 0.3 WINDOW w AS (PARTITION BY name ORDER BY round(common * 1.0 / whole, 9) DESC, other) QUALIFY row_number() OVER w <= 10""",
    "best_selection": """WITH p AS (SELECT p_type || '/' || p_size AS team, p_brand AS brand, CAST(floor(p_retailprice / 100) AS BIGINT) AS f FROM part),
        l AS (SELECT team, f, row_number() OVER (PARTITION BY team ORDER BY f DESC) AS i, count(*) OVER (PARTITION BY team) AS n FROM p),
        r AS (SELECT team, ascii(right(brand, 1)) % 7 + length(brand) AS g, row_number() OVER (PARTITION BY team ORDER BY ascii(right(brand, 1)) % 7 + length(brand) DESC) AS i FROM (SELECT DISTINCT team, brand FROM p))
        SELECT team, count(*) AS selected, CAST(sum(f * g) AS BIGINT) AS total, any_value(n) - count(*) AS unmatched FROM l JOIN r USING (team, i) GROUP BY team""",
    "spearman": """WITH p AS (SELECT p_brand AS family, p_size AS x, floor(p_retailprice / 10) AS y FROM part),
        r AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY x) + (count(*) OVER (PARTITION BY family, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY family ORDER BY y) + (count(*) OVER (PARTITION BY family, y) - 1) / 2.0 AS ry FROM p)
        SELECT family, count(*) AS n, CASE WHEN NOT isnan(corr(rx, ry)) THEN round(corr(rx, ry), 9) END AS rho FROM r GROUP BY family""",
}
