"""Tables in which statements are repeated: the work goes by distinct statements, and nothing of the tables' size is broadcast."""

import pytest
from pyspark.sql import functions as F

from stratia.operators import dimensions as dim
from stratia.operators import hypotheses as hy
from stratia.operators import logical
from stratia.operators import statements as st

COPIES = 40


def const(name):
    return f"c({len(name)}:{name},0)"


def stmt(f, x):
    return f"x-stmt-v1;a(a(c(1:P,0),{const(f)}),{const(x)})"


#: Four statements, of which the first two differ by one name, as do the last two.
FOUR = [stmt("aa", "xx"), stmt("bb", "xx"), stmt("aa", "yy"), stmt("bb", "yy")]


@pytest.fixture(scope="module")
def decls(spark):
    rows = [(i, f"n{i:03}", "theorem", "M", FOUR[i % 4]) for i in range(4 * COPIES)]
    return spark.createDataFrame([*rows, (900, "bad", "theorem", "M", "x-stmt-v1;("), (901, "none", "theorem", "M", None)], "seq long, name string, kind string, module string, stmt string")


def static_plan(df):
    """The plan as it is before anything runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_each_distinct_statement_is_read_once(decls):
    assert st._read(decls.filter("stmt is not null")).count() == 4
    parsed = st.parse(decls)
    assert parsed.count() == 4 * COPIES and "Broadcast" not in static_plan(parsed)
    assert parsed.columns == [c.split()[0] for c in st.PARSED.split(", ")]


def test_collapsed_rows_are_the_first_with_their_copies(decls):
    found = {r["name"]: r["copies"] for r in st.collapsed(decls).collect()}
    assert found == {f"n{i:03}": COPIES for i in range(4)}


def test_postings_count_copies(decls):
    firsts = st.collapsed(decls)
    keys = st.subterms(firsts).join(firsts.select("name", "copies"), "name")
    as_rows = lambda df: sorted((r["key"], r["n"], r["size"]) for r in df.collect())
    assert as_rows(st.postings(keys, 4 * COPIES)) == as_rows(st.postings(st.subterms(st.parse(decls)), 4 * COPIES))


def test_substitutions_count_pairs_of_copies(decls):
    firsts = st.collapsed(decls).cache()
    copies = firsts.select("name", "copies")
    found = st.variants(firsts).join(copies, "name").join(copies.toDF("other", "other_copies"), "other")
    got = {(r["a"], r["b"]): (r["skeletons"], r["pairs"]) for r in hy.substitutions(found, firsts.select("name", "rigid"), least=1).collect()}
    parsed = st.parse(decls)
    plain = {(r["a"], r["b"]): (r["skeletons"], r["pairs"]) for r in hy.substitutions(st.variants(parsed), parsed.select("name", "rigid"), least=1).collect()}
    assert got == plain and got["aa", "bb"] == (1, 2 * COPIES * COPIES)


def test_adjacent_classes_are_those_of_members(decls):
    firsts = st.collapsed(decls).cache()
    parsed = st.parse(decls)
    names = parsed.select("root", "name").join(firsts.select("root", F.col("name").alias("class")), "root").select("class", "name")
    got = sorted((r["via"], r["other"], r["n"]) for r in st.adjacent_classes(st.variants(firsts), names, 50).collect())
    plain = st.adjacent(parsed.select(F.col("root").alias("class"), "name", "seq"), st.variants(parsed), 50)
    assert got == sorted((r["via"], r["other"], r["n"]) for r in plain.collect()) and len(got) == 200


def test_ways_to_a_proof_meet_by_statement(decls, monkeypatch):
    seen, plain = [], st.variants
    monkeypatch.setattr(st, "variants", lambda rows, *a, **k: (seen.append(rows.count()), plain(rows, *a, **k))[1])
    parsed = st.parse(decls).withColumn("proved", (F.col("seq") % 4 == 1) | (F.col("seq") == 0)).cache()
    distances = {r["name"]: r["distance"] for r in hy.frontier_distance(parsed).collect()}
    assert distances == {f"n{i:03}": (0, None, 2, 1)[i % 4] if i % 4 != 2 else 1 for i in range(1, 4 * COPIES) if i % 4 != 1}
    routes = {(r["name"], r["route"]): r["proof"] for r in hy.routes(parsed).collect()}
    assert routes["n004", "exact"] == "n000" and len(routes) == COPIES - 1
    assert set(seen) == {4}


def test_dictionary_broadcasts_no_rows(decls):
    rows = st.erased(st.erased(st.parse(decls), "carriers"), "shape", "shape")
    assert "Broadcast" not in static_plan(rows)
    found = st.compare(st.meetings_between(st.sources(rows), st.sources(rows)), rows)
    assert "Broadcast" not in static_plan(found)


def test_transport_moves_each_distinct_subject_once(spark, decls, monkeypatch):
    """Of 40 copies of each statement; images are made and kept of distinct terms, and the rows are those of all triples."""
    rows = st.erased(st.parse(decls), "carriers").withColumn("k", F.lit(1)).cache()
    pairs = rows.filter("seq % 4 = 0").select(F.col("name").alias("left"), "k").join(rows.filter("seq in (1, 3)").select(F.col("name").alias("right")))
    subjects = rows.select(F.col("name").alias("subject"), "k", "erased")
    wanted = sorted(map(tuple, st.transport(pairs.join(subjects, "k").select("left", "right", "subject"), rows).collect()), key=str)
    kept, plain = {}, st.materialize
    monkeypatch.setattr(st, "materialize", lambda df, name: kept.setdefault(name, plain(df, name)))
    found = st.transport_all(pairs, subjects, rows, "k")
    assert sorted(map(tuple, found.collect()), key=str) == wanted and len(wanted) > COPIES * COPIES
    assert {name: df.count() for name, df in kept.items()} == {"pairs": 2 * COPIES, "subjects": 4 * COPIES, "images": 6}
    assert "Broadcast" not in static_plan(found)


def test_equations_and_sides_are_read_once_a_statement(decls):
    assert "Aggregate" in static_plan(dim.equations(decls)) and "Aggregate" in static_plan(dim.constraints(decls))
    parsed = st.parse(decls)
    assert logical.sides(parsed).count() == 4
    assert logical._judged(parsed).count() == 4 * COPIES


def test_neighbours_by_vocabulary_rank_the_first_of_a_kind(spark, decls, monkeypatch):
    """Of 40 copies of a statement in one module only as many as are asked for meet the classes."""
    kept, plain = [], st.materialize
    monkeypatch.setattr(st, "materialize", lambda df, name: (kept.append(name), plain(df, name))[1])
    parsed = st.parse(decls.withColumn("module", F.concat(F.lit("M"), (F.col("seq") % 2).cast("string"))))
    members = parsed.select(F.col("module").alias("class"), "name")
    found = st.vocabulary_adjacent(parsed, members, 4 * COPIES, share=0.5, top=3)
    assert sorted(map(tuple, found.collect())) == [("M0", "n001", 1, 80), ("M0", "n003", 1, 80), ("M0", "n005", 1, 80), ("M1", "n000", 1, 80), ("M1", "n002", 1, 80), ("M1", "n004", 1, 80)] and kept == ["kinds"]


def test_citations_that_filter_a_dictionary_are_between_its_theories(spark, monkeypatch):
    """Parts of an order that are not of the first and the last brand make no pairs."""
    import __spark_entry__ as entry
    from stratia.plans import statements as plans
    from stratia.sources import derived

    given = []
    monkeypatch.setattr(st, "filtered_dictionary", lambda *a: given.append(a[4]))
    plans._filtered(spark, entry.SMOKE)
    brand = {f"part:{r['p_partkey']}": r["p_brand"] for r in derived.table(spark, entry.SMOKE, "part").collect()}
    found = {(brand[r["src"]], brand[r["dst"]]) for r in given[0].collect()}
    assert found <= {(min(brand.values()), max(brand.values()))}
