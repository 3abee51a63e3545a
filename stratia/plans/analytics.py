"""Replacements across theories, two detectors crossed, smallest sets of hypotheses, features of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import crossing as cr
from stratia.operators import features as fe
from stratia.operators import hypotheses as hy
from stratia.operators import statements as st
from stratia.operators import subsets as su
from stratia.operators import symmetry as sy
from stratia.operators import transfer as tr
from stratia.plans import evidence
from stratia.plans import statements as plans
from stratia.session import checkpoint, materialize
from stratia.sources import derived


def transfer_halves(spark: SparkSession, d: str) -> DataFrame:
    """Replacements learned on half of the brands, held against the other half."""
    theories = derived.table(spark, d, "part").select(derived.node("part", "p_partkey").alias("name"), F.col("p_brand").alias("theory"))
    return tr.transfer(plans._parsed(spark, d), theories).withColumn("null_mean", F.round("null_mean", 6))


def transports(spark: SparkSession, d: str) -> DataFrame:
    return tr.transports(plans._parsed(spark, d))


def open_targets(spark: SparkSession, d: str) -> DataFrame:
    return tr.open_targets(plans._parsed(spark, d))


def _detectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, right, eligible) over orders and suppliers, of which those of one nation and parity count as equal statements."""
    t = lambda name: derived.table(spark, d, name)
    binders, ends, uses = evidence._lattice(spark, d)
    canon = lambda n, k: F.concat_ws(":", F.col(n).cast("string"), (F.col(k) % 2).cast("string")).alias("canon")
    members = t("supplier").select(derived.node("supplier", "s_suppkey").alias("name"), canon("s_nationkey", "s_suppkey"))
    members = members.union(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(derived.node("order", "o_orderkey"), canon("c_nationkey", "o_orderkey")))
    members, above = materialize(members, "members"), checkpoint(hy.ancestors(binders, ends))
    verdicts = materialize(hy.homes(binders, ends, uses, above), "verdicts")
    right = materialize(cr.stronger(members, binders.select("name", "class"), above), "stronger")
    crowd = members.groupBy("canon").agg(F.count("*").alias("n")).filter("n > 1")
    eligible = members.join(crowd, "canon").select("name").join(verdicts.filter("class is not null").select("name"), "name", "left_semi")
    return cr.over_strong(verdicts), right, eligible


def stronger_members(spark: SparkSession, d: str) -> DataFrame:
    return _detectors(spark, d)[1].select("name", F.array_join("weaker", "+").alias("weaker"))


def detectors_crossed(spark: SparkSession, d: str) -> DataFrame:
    left, right, _ = _detectors(spark, d)
    return cr.crossed(left, right)


def crossing_control(spark: SparkSession, d: str) -> DataFrame:
    out = cr.control(*_detectors(spark, d))
    return out.withColumn("base", F.round("base", 9)).withColumn("lifted", F.round("lifted", 9))


def minimal_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Of orders and suppliers the smallest sets of classes, at or above the asked one, that have all that their proofs need."""
    binders, ends, uses = evidence._lattice(spark, d)
    above = hy.small(checkpoint(hy.ancestors(binders, ends)))
    got = hy.evidence(binders, ends, uses, above)
    judged = hy.skips(binders, ends).filter("skipped is null").select("name")
    asks = checkpoint(binders.select("name", "class").distinct().join(judged, "name", "left_semi"))
    upset = hy.small(checkpoint(above.select("class", F.col("above").alias("at")).union(binders.select("class", F.col("class").alias("at")).distinct()).distinct()))
    items = checkpoint(asks.join(upset, "class").select(F.col("name").alias("goal"), F.col("at").alias("item")))
    needs = checkpoint(items.join(got.select(F.col("name").alias("goal"), F.col("class").alias("item")), ["goal", "item"]).select("goal", F.col("item").alias("need")).distinct())
    found, _ = su.minimal_sets(asks.select(F.col("name").alias("goal")), items, su.covers(needs, upset))
    return found.select(F.col("goal").alias("name"), F.array_join("items", ",").alias("items"))


def _declared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(decls, uses): all names with their kinds, in two spaces, and the laws that some of them state."""
    laws = derived.symmetry_laws(spark, d).select("name", "stmt")
    space = F.when(F.substring_index("name", ":", 1).isin("order", "customer"), "Sales").otherwise("Geo")
    decls = derived.names(spark, d).select("name", "kind", space.alias("space")).join(laws, "name", "left")
    return decls, derived.edges(spark, d).select(F.col("src").alias("name"), F.col("dst").alias("used"), "lens")


def declaration_features(spark: SparkSession, d: str) -> DataFrame:
    found = fe.features(*_declared(spark, d))
    return found.select("name", *(F.round(c, 9).alias(c) for c in fe.COLUMNS))


def features_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Held-out AUC of a fitted baseline, and of the fixed rank, at telling laws of exchange under a premise from others."""
    decls, uses = _declared(spark, d)
    table = materialize(fe.features(decls, uses), "features")
    swaps = sy.motifs(derived.symmetry_laws(spark, d)).filter("motif = 'SWAP_IMP'").select("name").distinct()
    labels = checkpoint(decls.filter("stmt is not null").select("name").join(swaps.withColumn("hit", F.lit(1)), "name", "left").select("name", F.coalesce("hit", F.lit(0)).alias("label")))
    scored = checkpoint(fe.baseline(table, labels))
    fixed = st.derivativeness(table.select("name", F.col("proof_size").alias("proof"), F.col("in_degree").alias("cited"), F.col("proof_frac_struct").alias("mechanical")))
    held = scored.filter("held_out").select("name")
    out = fe.judged({"fitted": scored.filter("held_out"), "fixed": fixed.join(held, "name").select("name", F.col("derivativeness").alias("score"))}, labels)
    return out.withColumn("auc", F.round("auc", 6))


QUERIES = {f.__name__: f for f in (transfer_halves, transports, open_targets, stronger_members, detectors_crossed, crossing_control, minimal_hypotheses, declaration_features, features_baseline)}

D, E, Y = derived.SQL["decls"], derived.SQL["edges"], derived.SQL["symmetries"]
UNIT = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
#: Distinct statements, pairs of them that differ by one name, and symbols with their places among all occurrences.
ONES = f"""{D}, reps AS MATERIALIZED (SELECT min(name) AS name, size, bucket, brand, type, layers FROM decls GROUP BY ALL),
    v AS MATERIALIZED (SELECT a.name, b.name AS other, a.size, a.bucket, a.brand AS ab, b.brand AS bb, CASE WHEN a.brand <> b.brand THEN a.brand ELSE a.type END AS a, CASE WHEN a.brand <> b.brand THEN b.brand ELSE b.type END AS b
        FROM reps a JOIN reps b ON a.size = b.size AND a.bucket = b.bucket AND (a.brand <> b.brand)::INT + (a.type <> b.type)::INT = 1),
    occ AS (SELECT sym, sum(n) AS n FROM (SELECT brand AS sym, count(*) AS n FROM reps GROUP BY 1 UNION ALL SELECT type, count(*) FROM reps GROUP BY 1 UNION ALL SELECT 'Part', count(*) FROM reps UNION ALL SELECT 'f', sum(layers) FROM reps) WHERE n > 0 GROUP BY sym),
    seen AS MATERIALIZED (SELECT sym, n, sum(n) OVER (ORDER BY sym) - n AS start, sum(n) OVER () AS total FROM occ)"""
IMAGES = """SELECT r.name, a, b, i.name AS image FROM reps r JOIN {0} ON a IN (brand, type) LEFT JOIN reps i ON i.size = r.size AND i.bucket = r.bucket AND i.brand = CASE WHEN r.brand = a THEN b ELSE r.brand END AND i.type = CASE WHEN r.type = a THEN b ELSE r.type END"""
INV = "inv AS MATERIALIZED (SELECT a, b FROM v GROUP BY 1, 2 HAVING count(DISTINCT (size, bucket)) >= 2)"
STRONG = """WITH m AS (SELECT 'supplier:' || s_suppkey AS name, s_nationkey AS n, s_suppkey % 2 AS p, CASE s_suppkey % 4 WHEN 0 THEN 'N' || s_nationkey WHEN 1 THEN 'R' || n_regionkey WHEN 2 THEN 'G' || s_nationkey % 4 ELSE 'Top' END AS asks FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'order:' || o_orderkey, c_nationkey, o_orderkey % 2, 'N' || c_nationkey || CASE WHEN o_orderkey % 10 = 7 THEN '+Top' ELSE '' END FROM orders JOIN customer ON c_custkey = o_custkey),
    k AS (SELECT DISTINCT n, p, asks FROM m),
    strong AS (SELECT m.name, min(k.asks) AS weaker FROM m JOIN k ON k.n = m.n AND k.p = m.p AND k.asks <> m.asks AND (m.asks LIKE 'N%' OR (m.asks <> 'Top' AND k.asks = 'Top')) GROUP BY m.name)"""
HOMES = evidence.SQL["hypothesis_homes"]
CROSS = f"""{STRONG}, homes AS ({HOMES}), l AS (SELECT DISTINCT name FROM homes WHERE verdict IN ('over-hypothesis', 'unused')),
    crossed AS (SELECT coalesce(l.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'left' WHEN l.name IS NULL THEN 'right' ELSE 'both' END AS flagged FROM l FULL JOIN strong s ON l.name = s.name),
    eligible AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM m WHERE (n, p) IN (SELECT (n, p) FROM m GROUP BY n, p HAVING count(*) > 1) AND name IN (SELECT name FROM homes WHERE class IS NOT NULL))"""
SQL = {
    "transfer_halves": f"""WITH {ONES}, w AS MATERIALIZED (SELECT least(a, b) AS lo, greatest(a, b) AS hi, size, bucket, {UNIT.format("'11:' || ab")} % 2 AS half FROM v WHERE name < other AND {UNIT.format("'11:' || ab")} % 2 = {UNIT.format("'11:' || bb")} % 2),
        learned AS (SELECT lo, hi, count(DISTINCT (size, bucket)) AS s FROM w WHERE half = 0 GROUP BY 1, 2), held AS (SELECT lo, hi, count(*) AS n FROM w WHERE half = 1 GROUP BY 1, 2),
        drawn AS (SELECT trial, least(lo, sym) AS lo, greatest(lo, sym) AS hi FROM (SELECT *, {UNIT.format("'11:' || trial || ':' || lo || ':' || hi")} AS u FROM held, range({tr.TRIALS}) r(trial)) JOIN seen ON u % total >= start AND u % total < start + seen.n),
        nulls AS (SELECT least, trial, count(s) AS c FROM (VALUES (1), (2), (3)) x(least), range({tr.TRIALS}) r(trial) LEFT JOIN (SELECT trial AS t, s FROM drawn JOIN learned USING (lo, hi)) y ON t = trial AND s >= least GROUP BY 1, 2)
        SELECT least, (SELECT count(*) FROM learned WHERE s >= least) AS inventory, (SELECT count(*) FROM held) AS held, (SELECT count(*) FROM held JOIN learned USING (lo, hi) WHERE s >= least) AS hits,
            (SELECT coalesce(sum(n), 0) FROM held) AS held_pairs, (SELECT coalesce(sum(n), 0) FROM held JOIN learned USING (lo, hi) WHERE s >= least) AS hit_pairs, round(avg(c), 6) AS null_mean, max(c) AS null_most FROM nulls GROUP BY least""",
    "transports": f"""WITH {ONES}, {INV}, c AS (SELECT DISTINCT a, sym AS b FROM (SELECT a, b AS own, {UNIT.format("'11:' || a || ':' || b")} AS u FROM inv WHERE a < b) JOIN seen ON u % total >= start AND u % total < start + n WHERE a <> sym)
        SELECT 'inventory' AS arm, count(*) AS tried, count(image) AS hits, count(*) - count(image) AS open FROM ({IMAGES.format('inv')}) UNION ALL SELECT 'control', count(*), count(image), count(*) - count(image) FROM ({IMAGES.format('c')})""",
    "open_targets": f"WITH {ONES}, {INV} {IMAGES.format('inv')}",
    "stronger_members": f"{STRONG} SELECT * FROM strong",
    "detectors_crossed": f"{CROSS} SELECT * FROM crossed",
    "crossing_control": f"""{CROSS}, f AS (SELECT flagged FROM crossed WHERE name IN (SELECT name FROM eligible)), c AS (SELECT (SELECT count(*) FROM eligible) AS n, count(*) FILTER (flagged <> 'left') AS r, count(*) FILTER (flagged <> 'right') AS l, count(*) FILTER (flagged = 'both') AS b FROM f),
        d AS (SELECT DISTINCT {UNIT.format("'20:' || i")} % (SELECT count(*) FROM eligible) AS i FROM (SELECT unnest(range(l)) AS i FROM c))
        SELECT n AS eligible, r AS "right", l AS "left", b AS "both", round(r / n, 9) AS base, round(b / l, 9) AS lifted, (SELECT count(*) FROM d JOIN eligible USING (i) WHERE name IN (SELECT name FROM strong)) AS sham FROM c""",
    "minimal_hypotheses": """WITH sup AS (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        o AS (SELECT o_orderkey AS k, c_nationkey AS n, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 10 NOT IN (3, 7)),
        x AS (SELECT k, o.n, o.r, coalesce(bool_or(l_suppkey % 4 = 0 AND sup.n = o.n), false) AS own, coalesce(bool_or(l_suppkey % 4 = 1 AND sup.r = o.r), false) AS region, coalesce(bool_or(l_suppkey % 4 = 2 AND sup.n % 4 = o.n % 4), false) AS part, coalesce(bool_or(l_suppkey % 4 = 3), false) AS top
            FROM o LEFT JOIN lineitem ON l_orderkey = k LEFT JOIN sup ON s_suppkey = l_suppkey GROUP BY ALL)
        SELECT 'order:' || k AS name, unnest(CASE WHEN own THEN ['N' || n] WHEN region AND part THEN ['N' || n, 'G' || n % 4 || ',R' || r] WHEN region THEN ['N' || n, 'R' || r] WHEN part THEN ['N' || n, 'G' || n % 4]
            WHEN top THEN ['N' || n, 'R' || r, 'G' || n % 4, 'Top'] ELSE [''] END) AS items FROM x UNION ALL SELECT 'supplier:' || s_suppkey, '' FROM sup""",
    "declaration_features": f"""WITH {E}, {derived.SQL['names']}, {Y}, enc AS (SELECT name, form, 'c(' || strlen(f) || ':' || f || ',0)' AS f, 'c(' || strlen(g) || ':' || g || ',0)' AS g, 'pd(c(1:T,0),' AS p, 'a(a(a(c(2:Eq,0),c(1:T,0)),' AS eq FROM symmetries),
        len_ AS (SELECT name, CASE WHEN form IN (0, 3, 5) THEN 1 ELSE 2 END + CASE WHEN form IN (3, 4) THEN 1 ELSE 0 END AS binders FROM enc),
        decl AS (SELECT name, kind, CASE WHEN split_part(name, ':', 1) IN ('order', 'customer') THEN 'Sales' ELSE 'Geo' END AS space FROM names),
        p AS (SELECT e.src AS name, count(*) AS up, count(*) FILTER (u.kind = 'theorem') AS t, count(*) FILTER (u.kind = 'def') AS d, count(*) FILTER (u.space <> n.space) AS f FROM edges e JOIN decl u ON u.name = e.dst JOIN decl n ON n.name = e.src WHERE lens = 'proof' GROUP BY 1),
        s AS (SELECT src AS name, count(*) AS us FROM edges WHERE lens = 'statement' GROUP BY 1), c AS (SELECT dst AS name, count(*) AS cited FROM edges GROUP BY 1),
        r AS (SELECT name, kind, coalesce(up, 0) AS up, coalesce(t, 0) AS t, coalesce(d, 0) AS d, coalesce(f, 0) AS f, coalesce(us, 0) AS us, coalesce(cited, 0) AS cited, coalesce(binders, 0) AS binders, greatest(coalesce(up, 0), 1) AS one FROM decl LEFT JOIN p USING (name) LEFT JOIN s USING (name) LEFT JOIN c USING (name) LEFT JOIN len_ USING (name)),
        text AS (SELECT name, strlen('x-stmt-v1;' || CASE form WHEN 0 THEN p || eq || 'a(' || f || ',a(' || g || ',b0))),a(' || f || ',b0)))' WHEN 1 THEN p || p || eq || 'a(a(' || f || ',b1),b0)),a(a(' || f || ',b0),b1))))'
            WHEN 2 THEN p || p || eq || 'a(a(' || f || ',b1),b0)),a(' || g || ',b1))))' WHEN 3 THEN p || 'pd(a(' || f || ',b0),a(' || f || ',a(' || g || ',b1))))' WHEN 4 THEN p || p || 'pd(a(a(' || f || ',b1),b0),a(a(' || f || ',b1),b2))))'
            ELSE p || eq || 'a(' || f || ',b0)),a(' || g || ',b0)))' END) AS enc FROM enc)
        SELECT name, round(t / one, 9) AS proof_frac_theorem, 0::DOUBLE AS proof_frac_recursor, 0::DOUBLE AS proof_frac_ctor, round(d / one, 9) AS proof_frac_def, 0::DOUBLE AS proof_frac_struct, round(up / greatest(us, 1), 9) AS proof_over_stmt, up::DOUBLE AS proof_size, us::DOUBLE AS stmt_size,
            coalesce(enc, 0)::DOUBLE AS enc_len, binders::DOUBLE AS n_binders, 0::DOUBLE AS frac_inst_binders, 0::DOUBLE AS frac_impl_binders, cited::DOUBLE AS in_degree, round(f / one, 9) AS foreign_proof, (kind = 'theorem')::INT::DOUBLE AS is_theorem FROM r LEFT JOIN text USING (name)""",
}
