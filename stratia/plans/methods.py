"""Queries on customers as objects with tags, a small catalogue of methods, and event traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import concepts, intuition
from stratia.sources import derived

ATTRIBUTES = ["automobile", "building", "furniture", "household", "machinery", "africa", "america", "asia", "europe", "middle east", "debtor", "buyer"]
METHODS = [
    {"method": "credit", "family": "finance", "recognizes": ["debtor"], "native": ["africa", "debtor"], "unlocks": ["buyer"]},
    {"method": "lease", "family": "finance", "recognizes": ["debtor", "automobile"], "native": ["automobile"], "unlocks": ["buyer", "machinery"]},
    {"method": "crane", "family": "works", "recognizes": ["building", "machinery", "buyer"], "native": ["building"], "unlocks": ["household", "furniture"]},
    {"method": "fair", "family": "sales", "recognizes": ["buyer"], "native": ["europe", "asia"], "unlocks": ["automobile", "furniture", "household"]},
    {"method": "catalogue", "family": "sales", "recognizes": ["buyer", "household", "furniture"], "native": ["household"], "unlocks": ["building"]},
    {"method": "tender", "family": "sales", "recognizes": ["africa", "america", "building"], "native": ["america"], "unlocks": []},
]


def _objects(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: derived.table(spark, d, n)
    buyers = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buyer", F.lit("buyer"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lower("r_name").alias("place"))
    rows = t("customer").join(places, "c_nationkey").join(buyers, "c_custkey", "left")
    tags = F.array_compact(F.array(F.lower("c_mktsegment"), "place", F.when(F.col("c_acctbal") < 0, "debtor"), "buyer"))
    return rows.select(derived.node("customer", "c_custkey").alias("name"), F.col("n_name").alias("theory"), tags.alias("tags"))


def _experience(spark: SparkSession, d: str) -> DataFrame:
    name = {"finance": "credit", "sales": "fair"}
    rows = derived.events(spark, d)
    method = F.when(F.col("method") == "purchase", name["sales"]).otherwise(name["finance"])
    return intuition.experience_factor(rows.select(F.concat(F.lit("customer:"), F.col("problem").cast("string")).alias("problem"), method.alias("method"), F.when(F.col("outcome") == "unknown", "inconclusive").otherwise(F.col("outcome")).alias("outcome")))


def experience_factor(spark: SparkSession, d: str) -> DataFrame:
    return _experience(spark, d).select("name", "method", F.round(F.log("experience"), 6).alias("log_factor"))


def profile_tags(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("colour", x) for x in ("red", "blue", "green")] + [("brand", "brand"), ("metal", "steel"), ("metal", "brass"), ("type", "o")], "tag string, needle string")
    rows = derived.table(spark, d, "part").select(derived.node("part", "p_partkey").alias("name"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("symbols"))
    return intuition.classify(rows, rules).select("name", "tag", F.array_join("evidence", ",").alias("evidence"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return intuition.candidates(_objects(spark, d), METHODS)


def method_rank(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("name", "method", *(F.round(c, 6).alias(c) for c in ("compatibility", "distance", "bridge", "novelty", "base")), F.col("gain").cast("long").alias("gain"))


def diversify(spark: SparkSession, d: str) -> DataFrame:
    return intuition.diversify(_scored(spark, d), top=4).select("name", "method", "rank", F.round("score", 6).alias("score"))


def pareto(spark: SparkSession, d: str) -> DataFrame:
    return intuition.pareto(_scored(spark, d)).select("name", "method", F.array_join("strengths", ",").alias("strengths"))


def theory_profile(spark: SparkSession, d: str) -> DataFrame:
    return intuition.theory_profile(_objects(spark, d))


def bridges(spark: SparkSession, d: str) -> DataFrame:
    profiles = _objects(spark, d).select(F.concat_ws("/", "theory", F.col("tags")[0]).alias("theory"), F.explode("tags").alias("tag")).groupBy("theory").agg(F.collect_set("tag").alias("tags"))
    return intuition.bridges(profiles, METHODS, top=50).select("from", "to", "method", F.round("score", 6).alias("score"))


def action_motifs(spark: SparkSession, d: str) -> DataFrame:
    return intuition.action_motifs(derived.events(spark, d))


def mrr_benchmark(spark: SparkSession, d: str) -> DataFrame:
    ranked = intuition.diversify(_scored(spark, d), top=len(METHODS))
    cases = _objects(spark, d).select(F.concat(F.lit("case:"), "name").alias("id"), F.col("name").alias("problem"), F.array(F.lit("fair"), F.lit("tender")).alias("expected"), F.array(F.lit("credit")).alias("excluded"), F.lit(1).alias("top_k"))
    return intuition.benchmark(ranked, cases).select("id", "rank", "hit", F.round("reciprocal", 6).alias("reciprocal"))


def explore(spark: SparkSession, d: str) -> DataFrame:
    found = intuition.explore(_objects(spark, d), METHODS)
    return found.select("name", F.array_join("path", ">").alias("path"), F.array_join("tags", ",").alias("tags"), "depth", F.round("score", 6).alias("score"), "breadth")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return concepts.masks(_objects(spark, d), ATTRIBUTES)


def fca_closure(spark: SparkSession, d: str) -> DataFrame:
    return concepts.closures(_counted(spark, d), [0, *(1 << i for i in range(len(ATTRIBUTES))), 1 << 5 | 1 << 6], len(ATTRIBUTES))


def implications(spark: SparkSession, d: str) -> DataFrame:
    return concepts.implications(_counted(spark, d), len(ATTRIBUTES))


def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = _objects(spark, d).select("theory", "tags")
    return concepts.missing_cells(rows).select("theory", "tag", "support", F.round("fraction", 6).alias("fraction"))


def fca_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts.lattice(_counted(spark, d), len(ATTRIBUTES))


def fca_covers(spark: SparkSession, d: str) -> DataFrame:
    return concepts.covers(concepts.lattice(_counted(spark, d), len(ATTRIBUTES)))


QUERIES = {f.__name__: f for f in (experience_factor, profile_tags, method_rank, diversify, pareto, theory_profile, bridges, action_motifs, mrr_benchmark, explore, fca_closure, implications, missing_cells, fca_concepts, fca_covers)}

OBJECTS = """objects AS (SELECT 'customer:' || c_custkey AS name, n_name AS theory, list_filter([lower(c_mktsegment), lower(r_name), CASE WHEN c_acctbal < 0 THEN 'debtor' END, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' END], lambda x: x IS NOT NULL) AS tags
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


CATALOGUE = "methods(i, method, family, recognizes, native, unlocks) AS (VALUES " + ", ".join(f"({i}, '{m['method']}', '{m['family']}', {_list(m['recognizes'])}, {_list(m['native'])}, {_list(m['unlocks'])})" for i, m in enumerate(METHODS)) + ")"
SHARE = lambda a, b: f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / len({a}) END)::DOUBLE"
SCORED = f"""WITH {OBJECTS}, {CATALOGUE},
    wide AS (SELECT o.*, m.*, list_distinct(tags || unlocks) AS after FROM objects o CROSS JOIN methods m),
    width AS (SELECT w.name, w.method, count(*) FILTER ({SHARE('k.recognizes', 'w.after')} >= 0.34) - count(*) FILTER ({SHARE('k.recognizes', 'w.tags')} >= 0.34) AS gain FROM wide w CROSS JOIN methods k GROUP BY w.name, w.method),
    parts AS (SELECT name, method, family, i, {SHARE('recognizes', 'tags')} AS compatibility, 1 - {SHARE('native', 'tags')} AS distance, CASE WHEN len(unlocks) = 0 THEN 0.0 ELSE 1 - {SHARE('unlocks', 'tags')} END AS bridge, CASE WHEN len(unlocks) = 0 THEN 0.5 ELSE 1 - {SHARE('unlocks', 'tags')} END AS novelty FROM wide),
    scored AS (SELECT p.*, greatest(gain, 0) AS gain, compatibility * (0.44 + 0.18 * distance + 0.16 * bridge + 0.10 * novelty + 0.12 * least(greatest(gain, 0) / 5, 1.0)) AS base FROM parts p JOIN width USING (name, method) WHERE compatibility > 0),
    penal AS (SELECT *, base * pow(0.68, row_number() OVER (PARTITION BY name, family ORDER BY round(base, 12) DESC, i) - 1) AS score FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 12) DESC, i) AS rank FROM penal)"""
BITS = " | ".join(f"(CASE WHEN list_contains(tags, '{a}') THEN {1 << i} ELSE 0 END)::BIGINT" for i, a in enumerate(ATTRIBUTES))
MASKS = f"{OBJECTS}, masks AS (SELECT {BITS} AS mask, count(*) AS n FROM objects GROUP BY 1)"
ALL = (1 << len(ATTRIBUTES)) - 1
AXES = (("compatibility", "compatibility"), ("distance", "domain-distance"), ("bridge", "bridge-value"), ("novelty", "novelty-of-view"), ("gain", "representation-breadth"))
SQL = {
    "experience_factor": f"""WITH {derived.SQL['traces']} SELECT 'customer:' || problem AS name, CASE method WHEN 'purchase' THEN 'fair' ELSE 'credit' END AS method, round(sum(CASE outcome WHEN 'succeeded' THEN ln(1.10) WHEN 'failed' THEN ln(0.55) ELSE ln(0.90) END), 6) AS log_factor FROM traces GROUP BY 1, 2""",
    "profile_tags": """WITH rules(tag, needle) AS (VALUES ('colour', 'red'), ('colour', 'blue'), ('colour', 'green'), ('brand', 'brand'), ('metal', 'steel'), ('metal', 'brass'), ('type', 'o')),
        s AS (SELECT DISTINCT 'part:' || p_partkey AS name, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS sym FROM part),
        h AS (SELECT DISTINCT name, tag, sym FROM s JOIN rules ON contains(lower(sym), needle)) SELECT name, tag, string_agg(sym, ',' ORDER BY sym) AS evidence FROM h GROUP BY name, tag""",
    "method_rank": SCORED + " SELECT name, method, round(compatibility, 6) AS compatibility, round(distance, 6) AS distance, round(bridge, 6) AS bridge, round(novelty, 6) AS novelty, round(base, 6) AS base, gain FROM scored",
    "diversify": SCORED + " SELECT name, method, rank, round(score, 6) AS score FROM ranked WHERE rank <= 4",
    "pareto": SCORED + f""" SELECT name, method, array_to_string(list_filter([{', '.join(f"CASE WHEN EXISTS (SELECT 1 FROM scored o WHERE o.name = s.name AND s.{a} > o.{a}) THEN '{b}' END" for a, b in AXES)}], lambda x: x IS NOT NULL), ',') AS strengths FROM scored s
        WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.name = s.name AND {' AND '.join(f'o.{a} >= s.{a}' for a, _ in AXES)} AND ({' OR '.join(f'o.{a} > s.{a}' for a, _ in AXES)}))""",
    "theory_profile": f"WITH {OBJECTS}, t AS (SELECT theory, unnest(tags) AS tag FROM objects) SELECT theory, tag, count(*) AS n FROM t GROUP BY 1, 2",
    "bridges": f"""WITH {OBJECTS}, {CATALOGUE}, t AS (SELECT theory, list(DISTINCT tag) AS tags FROM (SELECT theory || '/' || tags[1] AS theory, unnest(tags) AS tag FROM objects) GROUP BY theory),
        b AS (SELECT a.theory AS "from", b.theory AS "to", method, {SHARE('recognizes', 'a.tags')} AS fit, {SHARE('unlocks', 'b.tags')} AS echo, 1 - len(list_intersect(a.tags, b.tags)) * 1.0 / len(list_distinct(a.tags || b.tags)) AS distance, len(list_filter(unlocks, lambda x: NOT list_contains(a.tags, x))) AS fresh
            FROM t a JOIN t b ON a.theory <> b.theory CROSS JOIN methods)
        SELECT "from", "to", method, round(fit * echo * (0.65 + 0.35 * distance), 6) AS score FROM b WHERE fit > 0 AND echo > 0 AND fresh > 0 ORDER BY round(fit * echo * (0.65 + 0.35 * distance), 9) DESC, method, "from", "to" LIMIT 50""",
    "action_motifs": f"""WITH {derived.SQL['traces']}, p AS (SELECT method AS first, lead(method) OVER w AS second, lead(outcome) OVER w AS ends FROM traces WINDOW w AS (PARTITION BY problem ORDER BY step))
        SELECT first, second, count(*) AS count, count(*) FILTER (ends = 'succeeded') AS successes FROM p WHERE second IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
    "mrr_benchmark": SCORED + """, placed AS (SELECT name, method, row_number() OVER (PARTITION BY name ORDER BY rank) AS place FROM ranked WHERE method <> 'credit'), best AS (SELECT name, min(place) AS rank FROM placed WHERE method IN ('fair', 'tender') GROUP BY name),
        cases AS (SELECT DISTINCT o.name FROM objects o LEFT JOIN ranked r USING (name) WHERE r.method IS NULL OR r.method <> 'credit')
        SELECT 'case:' || o.name AS id, b.rank, coalesce(b.rank <= 1, false) AS hit, round(coalesce(1.0 / b.rank, 0), 6) AS reciprocal FROM cases o LEFT JOIN best b USING (name)""",
    "fca_closure": f"""WITH {MASKS}, seeds AS (SELECT unnest({[0, *(1 << i for i in range(len(ATTRIBUTES))), 1 << 5 | 1 << 6]}::BIGINT[]) AS seed)
        SELECT seed, coalesce(bit_and(mask), {ALL}) AS closure, CAST(coalesce(sum(n), 0) AS BIGINT) AS support FROM seeds LEFT JOIN masks ON mask & seed = seed GROUP BY seed""",
    "implications": f"""WITH {MASKS}, bits AS (SELECT unnest(range({len(ATTRIBUTES)})) AS i), seeds AS (SELECT DISTINCT (1::BIGINT << a.i::INT) | (1::BIGINT << b.i::INT) AS seed FROM bits a, bits b),
        c AS (SELECT seed, bit_and(mask) & ~seed AS consequent, CAST(sum(n) AS BIGINT) AS support FROM seeds JOIN masks ON mask & seed = seed GROUP BY seed) SELECT seed, consequent, support FROM c WHERE support >= 2 AND consequent <> 0""",
    "missing_cells": f"""WITH {OBJECTS}, t AS (SELECT theory, unnest(tags) AS tag FROM objects), c AS (SELECT tag, count(*) AS support, count(*) * 1.0 / (SELECT count(*) FROM objects) AS fraction FROM t GROUP BY tag)
        SELECT o.theory, c.tag, support, round(fraction, 6) AS fraction FROM (SELECT DISTINCT theory FROM objects) o CROSS JOIN c WHERE fraction >= 0.05 AND NOT EXISTS (SELECT 1 FROM t WHERE t.theory = o.theory AND t.tag = c.tag)""",
    "fca_concepts": f"WITH RECURSIVE {MASKS}, intents(intent) AS (SELECT {ALL}::BIGINT UNION SELECT intent & mask FROM intents, masks) SELECT intent FROM intents",
    "fca_covers": f"""WITH RECURSIVE {MASKS}, intents(intent) AS (SELECT {ALL}::BIGINT UNION SELECT intent & mask FROM intents, masks)
        SELECT a.intent AS lower, b.intent AS upper FROM intents a JOIN intents b ON a.intent & b.intent = a.intent AND a.intent <> b.intent
        WHERE NOT EXISTS (SELECT 1 FROM intents c WHERE c.intent & b.intent = c.intent AND a.intent & c.intent = a.intent AND c.intent <> a.intent AND c.intent <> b.intent)""",
}
