"""Slices of declarations as JSON lines: reading with validation, merging, restriction, digests; traces and cases.

Versions: rows whose `schema` ends in `-row-v2` have required fields; rows without `schema` are older and may lack
metadata, which then is unknown (null) and not empty. Blank lines don't count; line numbers start at 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratia.functions import terms

REQUIREMENTS = "array<struct<source:string,class:string,carrier:double>>"
ROW = f"schema string, name string, kind string, module string, is_instance boolean, stmt string, stmt_error string, uses_statement array<string>, uses_proof array<string>, requirements_statement {REQUIREMENTS}, _bad string"
OUTCOMES = {"success": "succeeded", "proved": "succeeded", "succeeded": "succeeded", "failure": "failed", "failed": "failed", "unstatable": "blocked", "blocked": "blocked", "refuted": "refuted", "unknown": "inconclusive", "inconclusive": "inconclusive"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): non-blank lines with their number in their file.

    A line's number is its place in the block of the file that one task reads, after the lines of the blocks before, so
    that no window holds more than a block, however large a file is.
    """
    text = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = text.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = text.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))).join(blocks, ["file", "block"])
    return placed.filter(F.trim("value") != "").select("file", (F.col("first") + F.col("place")).alias("line"), "value")


def parse(text: Column) -> Column:
    return F.from_json(text, ROW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def fault(r: str = "r") -> Column:
    """What is wrong with a parsed row; null for a valid one."""
    c = lambda name: F.col(f"{r}.{name}")
    v2 = c("schema").isNotNull()
    carrier = F.exists(c("requirements_statement"), lambda x: x["carrier"].isNull() | (x["carrier"] < 0) | (x["carrier"] != F.floor(x["carrier"])))
    return (
        F.when(F.col(r).isNull() | c("_bad").isNotNull(), "not a JSON object")
        .when(v2 & ~c("schema").rlike("^[a-z]+-row-v2$"), "unknown schema")
        .when(c("name").isNull(), "name is missing")
        .when(v2 & (c("kind").isNull() | c("module").isNull() | c("is_instance").isNull()), "kind, module or is_instance is missing")
        .when(v2 & (c("uses_statement").isNull() | c("uses_proof").isNull()), "uses are missing")
        .when(v2 & (F.exists(c("uses_statement"), lambda x: x.isNull()) | F.exists(c("uses_proof"), lambda x: x.isNull())), "a use is no text")
        .when(v2 & c("requirements_statement").isNull(), "requirements are missing")
        .when(v2 & F.coalesce(carrier, F.lit(False)), "a carrier is no position")
        .when(v2 & (c("stmt").isNull() == c("stmt_error").isNull()), "not exactly one of stmt and stmt_error")
    )


def faults(numbered: DataFrame) -> DataFrame:
    """(file, line, reason) of the lines that are no valid rows."""
    return numbered.withColumn("r", parse(F.col("value"))).select("file", "line", fault().alias("reason")).filter("reason is not null")


def read_rows(texts: DataFrame, order: str = "line") -> DataFrame:
    """Declarations of (order, value), with seq; older rows get empty use lists and texts, unknown metadata stays null."""
    r = texts.withColumn("r", parse(F.col("value"))).filter(fault().isNull())
    text = lambda name: F.coalesce(F.col(f"r.{name}"), F.lit(""))
    uses = lambda name: F.coalesce(F.array_compact(f"r.{name}"), F.array().cast("array<string>"))
    return r.select(F.col(order).cast("long").alias("seq"), F.col("r.name").alias("name"), text("kind").alias("kind"), text("module").alias("module"), F.col("r.is_instance").alias("is_instance"), F.col("r.stmt").alias("stmt"), uses("uses_statement").alias("uses_statement"), uses("uses_proof").alias("uses_proof"), F.col("r.requirements_statement").alias("requirements_statement"))


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of rows that share a name the last; lists are what a name maps to, so one row a name is a partial maximum."""
    best = rows.groupBy("name").agg(F.max("seq").alias("seq"))
    return rows.join(best, ["name", "seq"], "left_semi")


def first_of_each(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("name").agg(F.min("seq").alias("seq"))
    return rows.join(best, ["name", "seq"], "left_semi")


def edges(rows: DataFrame) -> DataFrame:
    """(src, dst, lens) of the use lists; edges to names that no row declares stay."""
    of = lambda lens: rows.select(F.col("name").alias("src"), F.explode(f"uses_{lens}").alias("dst"), F.lit(lens).alias("lens"))
    return of("statement").union(of("proof")).distinct()


def qualify(rows: DataFrame, namespace: str, rename: Column) -> DataFrame:
    """rows with names that meet `rename` (over column name) put under a namespace: names, uses and the names in statements.

    A statement meets the new names of its own symbols by a join; one that does not parse stays as it is.
    """
    moved = rows.filter(rename).select(F.col("name").alias("old"), F.concat(F.lit(f"{namespace}."), "name").alias("new")).distinct()
    out = rows.join(moved, rows.name == moved.old, "left").withColumn("name", F.coalesce("new", "name")).drop("old", "new")
    for column in ("uses_statement", "uses_proof"):
        used = out.select("seq", F.posexplode(column).alias("i", "old")).join(moved, "old", "left")
        lists = used.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("new", "old").alias("u")))).alias("l")).select("seq", F.col("l.u").alias("_new"))
        out = out.join(lists, "seq", "left").withColumn(column, F.coalesce("_new", F.array().cast("array<string>"))).drop("_new")
    return _renamed(out, moved)


def _renamed(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """rows with the names of moved (old, new) replaced inside statements; each distinct statement once."""

    def parsed(text: str):
        try:
            return terms.parse(text)
        except terms.TermError:
            return None

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x, s) for x in b.column(0).to_pylist() if (t := parsed(x)) is not None for s in dict.fromkeys(terms.symbols(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["stmt", "old"])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            made = [x[: x.index(";") + 1] + terms.render(terms.rename(parsed(x), {n["old"]: n["new"] for n in names})) for x, names in zip(texts, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["stmt", "_stmt"])

    used = rows.select("stmt").filter("stmt is not null").distinct().mapInArrow(symbols, "stmt string, old string").join(moved, "old")
    made = used.groupBy("stmt").agg(F.collect_list(F.struct("old", "new")).alias("names")).mapInArrow(change, "stmt string, _stmt string")
    return rows.join(made, "stmt", "left").withColumn("stmt", F.coalesce("_stmt", "stmt")).select(rows.columns)


def collisions(*slices: DataFrame) -> DataFrame:
    """(name, n): names that more than one slice declares."""
    every = slices[0].select("name").distinct()
    for s in slices[1:]:
        every = every.union(s.select("name").distinct())
    return every.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def below(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose module starts with a bare prefix."""
    return rows.filter(F.col("module").startswith(prefix))


def digest(rows: DataFrame) -> DataFrame:
    """One row: a digest of all declarations, whatever their order. Digests of rows are summed, not gathered.

    It differs from a digest of the file's bytes, which depends on the order of lines.
    """
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("name", "kind", "module", "stmt", "uses_statement", "uses_proof")), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest"))


def attempts(texts: DataFrame) -> DataFrame:
    """(problem, method, outcome, reason, step) of JSON lines (value); an unknown outcome raises, a step that is no whole number is null."""
    r = texts.filter(F.trim("value") != "").select(F.from_json("value", "problem string, method string, outcome string, reason string, step string").alias("r"))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair)), F.lower("r.outcome"))
    checked = F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce("r.outcome", F.lit("none")))))
    return r.select("r.problem", "r.method", checked.alias("outcome"), "r.reason", F.when(F.col("r.step").rlike(r"^-?\d{1,18}$"), F.col("r.step").cast("long")).alias("step"))


def cases(texts: DataFrame) -> DataFrame:
    """(id, problem, expected, excluded, top_k) of JSON lines; lines that start with # don't count, empty expectations raise."""
    r = texts.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    r = r.select(F.from_json("value", "id string, problem string, expected_methods array<string>, top_k int, excluded_methods array<string>").alias("r"))
    expected = F.when(F.coalesce(F.size("r.expected_methods"), F.lit(0)) > 0, F.col("r.expected_methods")).otherwise(F.raise_error(F.concat(F.lit("no expected methods: "), F.coalesce("r.id", F.lit("")))))
    return r.select("r.id", "r.problem", expected.alias("expected"), F.coalesce("r.excluded_methods", F.array().cast("array<string>")).alias("excluded"), F.coalesce("r.top_k", F.lit(10)).alias("top_k"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Write a slice as JSON lines, in the order of names across files."""
    rows.orderBy("name").write.json(path)
