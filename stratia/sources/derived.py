"""A corpus derived from star-schema tables, for queries and their SQL.

Nodes are rows of the tables, named `table:key`. Statement edges go from orders to parts and from parts to suppliers,
proof edges along the other keys. Parts are declarations whose statement is a term over their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "x-stmt-v1;"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, lens), each edge once."""
    t = lambda name: table(spark, sf_dir, name)
    e = lambda df, a, b, lens: df.select(node(*a).alias("src"), node(*b).alias("dst"), F.lit(lens).alias("lens"))
    items = t("lineitem")
    return (
        e(items.select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), "statement")
        .union(e(items.select("l_orderkey", "l_partkey").distinct(), ("order", "l_orderkey"), ("part", "l_partkey"), "statement"))
        .union(e(t("orders"), ("order", "o_orderkey"), ("customer", "o_custkey"), "proof"))
        .union(e(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "proof"))
        .union(e(t("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "proof"))
        .union(e(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "proof"))
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, module) of all nodes: regions are axioms, nations definitions, the rest theorems."""
    keys = {"part": "p_partkey", "supplier": "s_suppkey", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
    kind = {"region": "axiom", "nation": "def"}
    out = None
    for name, key in keys.items():
        short = "order" if name == "orders" else name
        one = table(spark, sf_dir, name).select(node(short, key).alias("name"), F.lit(kind.get(name, "theorem")).alias("kind"), F.lit(f"Trade.{short.capitalize()}").alias("module"))
        out = one if out is None else out.union(one)
    return out


def statement() -> Column:
    """A part's term: Part applied to brand, type, size and price bucket, in p_size % 4 layers of f."""
    const = lambda c: F.concat(F.lit("c("), F.octet_length(c).cast("string"), F.lit(":"), c, F.lit(",0)"))
    app = lambda f, x: F.concat(F.lit("a("), f, F.lit(","), x, F.lit(")"))
    number = lambda c: F.concat(F.lit("n"), c.cast("string"))
    bucket = F.floor(F.col("p_retailprice") / 100).cast("long")
    core = app(app(app(app(F.lit("c(4:Part,0)"), const(F.col("p_brand"))), const(F.col("p_type"))), number(F.col("p_size"))), number(bucket))
    layers = F.col("p_size") % 4
    return F.concat(F.lit(PREFIX), F.expr("repeat('a(c(1:f,0),', p_size % 4)"), core, F.repeat(F.lit(")"), layers.cast("int")))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, kind, module, stmt) of parts; seq is the order of the slice."""
    kind = F.element_at(F.array(F.lit("theorem"), F.lit("def"), F.lit("axiom")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), node("part", "p_partkey").alias("name"), kind.alias("kind"),
        F.concat_ws(".", F.lit("Mfgr"), "p_brand", "p_type").alias("module"), statement().alias("stmt"),
    )


def binder_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, kind, module, stmt) of laws with binders, one a customer, and of the relation Rel that they speak of.

    A law takes a type, an instance of the segment's class over it and an element, and states Rel of a type (bound, or one
    of two constants), an instance and a number. Rel takes its first two arguments implicitly and by instance.
    """
    c = table(spark, sf_dir, "customer")
    sized = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    k = F.col("c_custkey")
    carrier = F.element_at(F.array(F.lit("b2"), F.lit("c(3:Int,0)"), F.lit("c(3:Rat,0)")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    sort = F.when(k % 2 == 0, "+(0)").otherwise("u1")
    body = F.concat(F.lit("a(a(a(c(3:Rel,0),"), carrier, F.lit("),c(5:inst"), (k % 4).cast("string"), F.lit(",0)),n"), (k % 10).cast("string"), F.lit(")"))
    stmt = F.concat(F.lit(PREFIX + "pi(s("), sort, F.lit("),pt(a(c("), sized(F.col("c_mktsegment")), F.lit(",0),b0),pd(b1,"), body, F.lit(")))"))
    laws = c.select(k.alias("seq"), F.concat(F.lit("law:"), k.cast("string")).alias("name"), F.when(k % 5 == 0, "axiom").otherwise("theorem").alias("kind"), F.concat(F.lit("Laws."), "c_mktsegment").alias("module"), stmt.alias("stmt"))
    rel = spark.range(1).select(F.lit(-1).cast("long"), F.lit("Rel"), F.lit("def"), F.lit("Laws"), F.lit(PREFIX + "pi(s(+(0)),pt(a(c(4:Ring,0),b0),pd(b1,s(0))))"))
    return laws.union(rel)


def quantity_laws(spark: SparkSession, sf_dir: str, off: Column | None = None) -> DataFrame:
    """(seq, name, kind, module, stmt) of laws about quantities, one a part: brand^m x + type^n x = y for all x and y.

    A brand or type is a quantity of its own in each of five kinds (by size), of weight 1 to 4 or 1 to 3; the powers are the
    other's weight, so that all laws of a kind agree. off: a number that is added to the brand's power.
    """
    p = table(spark, sf_dir, "part")
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    two = lambda f, a, b: F.concat(F.lit(f"a(a(c({len(f)}:{f},0),"), a, F.lit("),"), b, F.lit(")"))
    atom = lambda c: F.concat(F.lit("a(a(c(3:dim,0),c("), sized(c), F.lit(",0)),n"), (F.col("p_size") % 5).cast("string"), F.lit(")"))
    of_brand, of_type = F.ascii(F.substring("p_brand", -1, 1)) % 4 + 1, F.octet_length("p_type") % 3 + 1
    power = lambda c, n: two("HPow.hPow", atom(F.col(c)), F.concat(F.lit("n"), n.cast("string")))
    left = two("HMul.hMul", power("p_brand", of_type + (F.lit(0) if off is None else off)), F.lit("b1"))
    right = two("HMul.hMul", power("p_type", of_brand), F.lit("b1"))
    stmt = F.concat(F.lit(PREFIX + "pd(c(4:Real,0),pd(c(4:Real,0),a(a(a(c(2:Eq,0),c(4:Real,0)),"), two("HAdd.hAdd", left, right), F.lit("),b0)))"))
    return p.select(F.col("p_partkey").alias("seq"), node("part", "p_partkey").alias("name"), F.lit("theorem").alias("kind"), F.lit("Quantities").alias("module"), stmt.alias("stmt"))


def symmetry_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, name, kind, module, stmt) of laws about the functions f and g of parts, suppliers and orders, six forms by key.

    For all x (and y): 0 f(g x) = f x; 1 f x y = f y x; 2 f x y = g x; 3 f x gives f(g x); 4 f x y gives f y x; 5 f x = g x.
    """
    sized = lambda c: F.concat(F.lit("c("), F.octet_length(c).cast("string"), F.lit(":"), c, F.lit(",0)"))

    def laws(name: str, kind: str, key: str, f: Column, g: Column, seq: int) -> DataFrame:
        f, g = sized(f), sized(g)
        app = lambda h, *xs: app(F.concat(F.lit("a("), h, F.lit(","), xs[0], F.lit(")")), *xs[1:]) if xs else h
        b = [F.lit(f"b{i}") for i in range(4)]
        eq = lambda x, y: app(F.lit("c(2:Eq,0)"), F.lit("c(1:T,0)"), x, y)
        one = lambda body: F.concat(F.lit("pd(c(1:T,0),"), body, F.lit(")"))
        given = lambda x, y: F.concat(F.lit("pd("), x, F.lit(","), y, F.lit(")"))
        forms = [
            one(eq(app(f, app(g, b[0])), app(f, b[0]))), one(one(eq(app(f, b[1], b[0]), app(f, b[0], b[1])))), one(one(eq(app(f, b[1], b[0]), app(g, b[1])))),
            one(given(app(f, b[0]), app(f, app(g, b[1])))), one(one(given(app(f, b[1], b[0]), app(f, b[1], b[2])))), one(eq(app(f, b[0]), app(g, b[0]))),
        ]
        body = F.element_at(F.array(*forms), (F.col(key) % 6 + 1).cast("int"))
        return table(spark, sf_dir, name).select((F.col(key) * 3 + seq).alias("seq"), node(kind, key).alias("name"), F.lit("theorem").alias("kind"), F.concat_ws(".", F.lit("Sym"), F.lit(kind), g_module(name)).alias("module"), F.concat(F.lit(PREFIX), body).alias("stmt"))

    def g_module(name: str) -> Column:
        return {"part": F.col("p_brand"), "supplier": F.col("s_nationkey").cast("string"), "orders": F.col("o_orderstatus")}[name]

    number = lambda c, word: F.concat(F.lit(word), F.col(c).cast("string"))
    return (
        laws("part", "part", "p_partkey", F.col("p_brand"), F.col("p_type"), 0)
        .union(laws("supplier", "supplier", "s_suppkey", F.lit("Sup"), number("s_nationkey", "N"), 1))
        .union(laws("orders", "order", "o_orderkey", F.lit("Ord"), F.concat(F.lit("S"), F.col("o_orderstatus")), 2))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as steps of a user's trace: (problem, step, method, outcome)."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    outcome = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("unknown")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("problem"), F.row_number().over(order).cast("long").alias("step"), F.col("event_type").alias("method"), outcome.alias("outcome"))


#: The same relations as SQL, for use after WITH.
SQL = {
    "edges": """edges AS (
        SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'statement' AS lens FROM lineitem
        UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'statement' FROM lineitem
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'proof' FROM orders
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'proof' FROM customer
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'proof' FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'proof' FROM supplier)""",
    "names": """names AS (
        SELECT 'part:' || p_partkey AS name, 'theorem' AS kind, 'Trade.Part' AS module FROM part
        UNION ALL SELECT 'supplier:' || s_suppkey, 'theorem', 'Trade.Supplier' FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'theorem', 'Trade.Order' FROM orders
        UNION ALL SELECT 'customer:' || c_custkey, 'theorem', 'Trade.Customer' FROM customer
        UNION ALL SELECT 'nation:' || n_nationkey, 'def', 'Trade.Nation' FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, 'axiom', 'Trade.Region' FROM region)""",
    "decls": """decls AS (
        SELECT p_partkey AS seq, 'part:' || p_partkey AS name, ['theorem', 'def', 'axiom'][p_size % 3 + 1] AS kind, 'Mfgr.' || p_brand || '.' || p_type AS module,
            p_size AS size, CAST(floor(p_retailprice / 100) AS BIGINT) AS bucket, p_brand AS brand, p_type AS type, p_size % 4 AS layers,
            'x-stmt-v1;' || repeat('a(c(1:f,0),', p_size % 4) || 'a(a(a(a(c(4:Part,0),c(' || strlen(p_brand) || ':' || p_brand || ',0)),c(' || strlen(p_type) || ':' || p_type || ',0)),n' || p_size || '),n'
            || CAST(floor(p_retailprice / 100) AS BIGINT) || ')' || repeat(')', p_size % 4) AS stmt FROM part)""",
    "laws": """laws AS (
        SELECT c_custkey AS seq, 'law:' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 'axiom' ELSE 'theorem' END AS kind, c_mktsegment AS class, ['b2', 'c(3:Int,0)', 'c(3:Rat,0)'][c_nationkey % 3 + 1] AS carrier,
            CASE WHEN c_custkey % 2 = 0 THEN '+(0)' ELSE 'u1' END AS sort, c_custkey % 4 AS inst, c_custkey % 10 AS x FROM customer),
    levels AS (
        SELECT name, kind, class, 'pi(s(' || sort || '),pt(a(c(' || strlen(class) || ':' || class || ',0),b0),pd(b1,' || body || ')))' AS exact, 'pi(s(*),pt(a(c(' || strlen(class) || ':' || class || ',0),b0),pd(b1,' || body || ')))' AS presentation,
            'pi(s(*),pt(_,pd(b1,a(a(a(c(3:Rel,0),' || carrier || '),_),n' || x || '))))' AS instances, 'pi(_,pt(_,pd(b1,a(a(a(c(3:Rel,0),_),_),n' || x || '))))' AS carriers, 'pd(_,pd(_,pd(b1,a(a(a(_,_),_),_))))' AS shape, body AS concludes
        FROM (SELECT *, 'a(a(a(c(3:Rel,0),' || carrier || '),c(5:inst' || inst || ',0)),n' || x || ')' AS body FROM laws)
        UNION ALL SELECT 'Rel', 'def', 'Ring', 'pi(s(+(0)),pt(a(c(4:Ring,0),b0),pd(b1,s(0))))', 'pi(s(*),pt(a(c(4:Ring,0),b0),pd(b1,s(*))))', 'pi(s(*),pt(_,pd(b1,s(*))))', 'pi(_,pt(_,pd(b1,s(*))))', 'pd(_,pd(_,pd(b1,s(*))))', 's(0)')""",
    "quantities": """quantities AS (
        SELECT p_partkey AS seq, 'part:' || p_partkey AS name, p_size % 5 AS kind, ascii(right(p_brand, 1)) % 4 + 1 AS wb, strlen(p_type) % 3 + 1 AS wt,
            'dim(c(' || strlen(p_brand) || ':' || p_brand || ',0),n' || p_size % 5 || ')' AS b, 'dim(c(' || strlen(p_type) || ':' || p_type || ',0),n' || p_size % 5 || ')' AS t FROM part)""",
    "symmetries": """symmetries AS (
        SELECT 'part:' || p_partkey AS name, p_partkey % 6 AS form, p_brand AS f, p_type AS g, 'Sym.part.' || p_brand AS module FROM part
        UNION ALL SELECT 'supplier:' || s_suppkey, s_suppkey % 6, 'Sup', 'N' || s_nationkey, 'Sym.supplier.' || s_nationkey FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, o_orderkey % 6, 'Ord', 'S' || o_orderstatus, 'Sym.order.' || o_orderstatus FROM orders),
    hits AS (SELECT name, ['INV', 'SWAP', 'CONS', 'INV_IMP', 'SWAP_IMP'][form + 1] AS motif, form <> 2 AS strict, CASE WHEN form IN (1, 4) THEN 2 ELSE 1 END AS variables, CASE WHEN form IN (0, 3) THEN 'a1:' || g END AS context,
        CASE WHEN form IN (0, 3) THEN 'a1' END AS shape, ['R<L', 'swap', 'L>R', 'L<R', 'swap'][form + 1] AS direction, CASE WHEN form < 3 THEN 'Eq' ELSE f END AS head, CASE WHEN form < 3 THEN 3 ELSE -1 END AS arity, false AS whole, module
        FROM symmetries WHERE form < 5)""",
    "traces": """traces AS (
        SELECT user_id AS problem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS method,
            CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'unknown' END AS outcome FROM events)""",
}
