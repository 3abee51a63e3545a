"""A kept index: deltas equal a rebuild, text is not read again, and a stream feeds it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratia.operators import statements as st
from stratia.operators.kept import Kept
from stratia.streaming import ingest

SCHEMA = "seq long, name string, kind string, module string, stmt string"
V = "x-stmt-v1;"


def const(name):
    return f"c({len(name)}:{name},0)"


def app(f, *xs):
    for x in xs:
        f = f"a({f},{x})"
    return f


def made(rng, i, name):
    return (i, name, "theorem", "M", V + app(const("Rel"), app(const(rng.choice("fgh")), const(rng.choice("AB"))), f"n{rng.randint(0, 2)}"))


def postings(df):
    return sorted((r.key, r.n, r.size, round(r.idf, 9)) for r in df.collect())


def whole(spark, rows):
    last = {}
    for r in rows:
        last[r[1]] = r
    parsed = st.parse(spark.createDataFrame(list(last.values()), SCHEMA))
    keys = st.subterms(parsed).filter(F.col("size") >= F.when(F.col("closed"), st.CLOSED).otherwise(st.OPEN))
    return postings(st.postings(keys, parsed.count())), {r.name: r.root for r in parsed.collect()}


def test_deliveries_equal_a_rebuild_with_replaced_and_withdrawn_rows(spark, tmp_path):
    rng, index, rows = random.Random(4), Kept(spark, str(tmp_path)), []
    for number in range(3):
        new = [made(rng, 100 * number + i, f"n{rng.randint(0, 25)}") for i in range(20)]
        new += [(100 * number + 50, f"n{number}", "def", "M", None), (100 * number + 51, "odd", "def", "M", "x-stmt-v1;(")]
        rows += new
        index.add(spark.createDataFrame(new, SCHEMA), number)
        want, roots = whole(spark, rows)
        assert postings(index.postings()) == want
        assert {r.name: r.root for r in index.statements().collect()} == roots and index.total() == len(roots)


def test_a_second_reading_reads_no_statements_and_replays_change_nothing(spark, tmp_path):
    rng, index = random.Random(5), Kept(spark, str(tmp_path))
    rows = spark.createDataFrame([made(rng, i, f"n{i}") for i in range(30)], SCHEMA)
    index.add(rows, 0)
    before = postings(index.postings())
    plan = index.postings()._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and all("/keys/" in f for f in index.postings().inputFiles())
    assert index.add(rows.repartition(3), 0) == index.deliveries()[0][1] and len(index.deliveries()) == 1
    with pytest.raises(ValueError, match="late"):
        index.add(rows.limit(3), 0)
    index.add(rows.limit(0), 5)
    with pytest.raises(ValueError, match="late"):
        index.add(rows, 4)
    assert postings(Kept(spark, str(tmp_path)).postings()) == before
    assert Kept(spark, str(tmp_path), of="concludes").deliveries() == []


def test_an_unfinished_delivery_is_written_again(spark, tmp_path, monkeypatch):
    rng, index = random.Random(6), Kept(spark, str(tmp_path))
    rows = spark.createDataFrame([made(rng, i, f"n{i}") for i in range(10)], SCHEMA)
    monkeypatch.setattr(Kept, "_keys", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(rows, 0)
    monkeypatch.undo()
    assert index.deliveries() == [] and index.postings().count() == 0
    index.add(rows, 0)
    assert index.statements().count() == 10


def test_a_stream_feeds_the_index(spark, tmp_path):
    rng, index = random.Random(7), Kept(spark, str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    row = lambda r: json.dumps({"schema": "x-row-v2", "name": r[1], "kind": r[2], "module": r[3], "is_instance": False, "stmt": r[4], "uses_statement": [], "uses_proof": [], "requirements_statement": []})
    rows = []
    for part in range(2):
        new = [made(rng, 50 * part + i, f"n{i + 5 * part}") for i in range(12)]
        rows += new
        (tmp_path / "in" / f"{part}.jsonl").write_text("\n".join(row(r) for r in new) + "\n")
        ingest.follow(spark, str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "faults"), str(tmp_path / "check"), index.add).awaitTermination()
    want, _ = whole(spark, rows)
    assert len(index.deliveries()) == 2 and postings(index.postings()) == want
