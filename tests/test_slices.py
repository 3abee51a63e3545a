import json

import pytest

from stratia.functions import terms as t
from stratia.operators import logical, statements
from stratia.sources import slices
from stratia.streaming import ingest

V2 = {"schema": "x-row-v2", "name": "a", "kind": "theorem", "module": "M", "is_instance": False, "stmt": "x-stmt-v1;n1", "uses_statement": ["b"], "uses_proof": ["c", "b"], "requirements_statement": [{"source": "s", "class": "c", "carrier": 0}]}
BAD = [
    ("not json", "not a JSON object"), ({**V2, "schema": "x-row-v9"}, "unknown schema"), ({k: v for k, v in V2.items() if k != "name"}, "name is missing"),
    ({**V2, "kind": None}, "kind, module or is_instance is missing"), ({**V2, "uses_proof": None}, "uses are missing"), ({**V2, "uses_proof": ["x", None]}, "a use is no text"),
    ({**V2, "requirements_statement": None}, "requirements are missing"), ({**V2, "requirements_statement": [{"source": "s", "class": "c", "carrier": -1}]}, "a carrier is no position"), ({**V2, "stmt_error": "e"}, "not exactly one of stmt and stmt_error"),
]


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_faults_have_line_numbers(spark, tmp_path):
    write(tmp_path / "a.jsonl", ["", V2, *(r for r, _ in BAD), {"name": "old"}])
    numbered = slices.lines(spark, str(tmp_path / "a.jsonl"))
    assert [(r.line, r.reason) for r in slices.faults(numbered).orderBy("line").collect()] == [(i + 3, why) for i, (_, why) in enumerate(BAD)]
    rows = {r.name: r for r in slices.read_rows(numbered).collect()}
    assert set(rows) == {"a", "old"} and rows["old"].uses_proof == [] and rows["old"].is_instance is None and rows["old"].requirements_statement is None
    assert {tuple(r) for r in slices.edges(slices.read_rows(numbered)).collect()} == {("a", "b", "statement"), ("a", "c", "proof"), ("a", "b", "proof")}


def test_repeated_names_and_merging(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"name": "x", "module": "One"}, {"name": "y", "uses_proof": ["x", "z"]}, {"name": "x", "module": "Two"}])
    rows = slices.read_rows(slices.lines(spark, str(tmp_path / "a.jsonl")))
    assert [r.module for r in slices.last_of_each(rows).filter("name = 'x'").collect()] == ["Two"]
    assert [r.module for r in slices.first_of_each(rows).filter("name = 'x'").collect()] == ["One"]
    moved = slices.qualify(rows, "N", rows.name == "x")
    assert {r.name: r.uses_proof for r in moved.collect()} == {"N.x": [], "y": ["N.x", "z"]}
    assert slices.collisions(rows, moved).collect()[0].name == "y"
    assert slices.digest(rows).collect() == slices.digest(rows.repartition(3)).collect() != slices.digest(moved).collect()


def test_attempts_and_cases(spark):
    text = lambda *rows: spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")
    got = slices.attempts(text({"problem": "p", "method": "m", "outcome": "proved", "step": 2}, " ", {"problem": "p", "method": "m", "outcome": "unstatable", "step": "soon"})).collect()
    assert [(r.outcome, r.step) for r in got] == [("succeeded", 2), ("blocked", None)]
    with pytest.raises(Exception, match="unknown outcome"):
        slices.attempts(text({"problem": "p", "method": "m", "outcome": "maybe"})).collect()
    got = slices.cases(text("# a remark", {"id": "1", "problem": "p", "expected_methods": ["m"]})).collect()
    assert (got[0].top_k, got[0].excluded) == (10, [])
    with pytest.raises(Exception, match="no expected methods"):
        slices.cases(text({"id": "1", "problem": "p", "expected_methods": []})).collect()


def test_a_stream_appends_valid_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    follow = lambda: ingest.follow(spark, str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "faults"), str(tmp_path / "check")).awaitTermination()
    write(tmp_path / "in" / "1.jsonl", [V2, "broken"])
    follow()
    write(tmp_path / "in" / "2.jsonl", [{**V2, "module": "Later"}])
    follow()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert [r.module for r in slices.last_of_each(rows.drop("batch")).collect()] == ["Later"] and rows.count() == 2
    assert spark.read.parquet(str(tmp_path / "faults")).count() == 1


def test_logical_edges(spark):
    c = lambda n: ("c", (n, ()))
    app = lambda f, *xs: app(("a", "", f, xs[0]), *xs[1:]) if xs else f
    pi = lambda d, b: ("p", "d", d, b)
    rows = [
        ("iff", "theorem", pi(c("T"), app(c("Iff"), app(c("P"), ("b", 0)), app(c("Q"), ("b", 0))))), ("same", "theorem", app(c("Iff"), app(c("P"), c("x")), app(c("P"), c("y")))),
        ("imp", "axiom", pi(app(c("Q"), c("x")), app(c("P"), c("x")))), ("flex", "theorem", pi(app(("b", 3), c("x")), app(c("P"), c("x")))),
        ("type", "theorem", pi(c("Nat"), app(c("P"), c("x")))), ("q", "theorem", app(c("Q"), c("x"))), ("d", "def", pi(app(c("Q"), c("x")), app(c("P"), c("x")))),
    ]
    decls = spark.createDataFrame([(i, n, k, "M", "x-stmt-v1;" + t.render(x)) for i, (n, k, x) in enumerate(rows)], "seq long, name string, kind string, module string, stmt string")
    parsed = statements.parse(decls)
    assert {(r.theorem, r.asserted, r.form, r.l, r.r) for r in logical.edges(parsed).collect()} == {("iff", False, "iff", "P/1", "Q/1"), ("imp", True, "implies", "Q/1", "P/1")}
    got = logical.stats(parsed).collect()[0]
    assert (got.iff_edges, got.implication_edges, got.flex_head_sides, got.same_head_sides, got.non_prop_sides) == (1, 1, 1, 1, 1)
    assert {(r.source, r.target, len(r.path)) for r in logical.paths(logical.edges(parsed), spark.createDataFrame([("Q/1",)], "source string")).collect()} == {("Q/1", "Q/1", 1), ("Q/1", "P/1", 2)}


def test_transport_depends_on_the_subject():
    a = lambda *xs: f"a({a(*xs[:-1])},{xs[-1]})" if len(xs) > 1 else xs[0]
    left, right = a("c(1:f,0)", "c(1:x,0)", "n1"), a("c(1:f,0)", "c(1:y,0)", "n1")
    assert statements.image(left, right, left) == right
    assert statements.image(left, right, a("c(1:f,0)", "c(1:z,0)", "n1")) == a("c(1:f,0)", "c(1:z,0)", "n1")
    assert statements.image(left, right, a("c(1:f,0)", "c(1:x,0)", "n2")) is None
