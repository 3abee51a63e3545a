"""Dimensions over a whole corpus: equations of all statements, solved exactly by rounds of joins on leading atoms.

An equation is a row of integers over atoms. Rows go through two phases, in which every step is a join or a grouped sum:

* forwards, the rows that share their first atom keep the earliest of them (by seq and number in its statement) and take
  its multiple from the others, until all first atoms differ. A row changes only by earlier ones, so a row that ends
  empty is implied by rows before it, and the rest are the earliest independent rows;
* backwards, each row takes in the rows of all its other leading atoms at once, which halves the depth of what is left.

Before that, blocks of BLOCK rows that follow one another are done in a task each, and blocks of what they leave, as long as
that makes much fewer rows: most equations of a corpus say again what others near them say. What remains of a corpus with
few atoms is one block, and rounds are left with nothing to do.

Arithmetic is in whole decimals of 38 digits without fractions, rows without common factors; what does not fit raises.
Equal equations are collapsed before they meet, so that copies of statements are one row. A round writes the rows that
it has changed and reads the rest where they are, so that its cost follows the changes; nothing but counts reaches the
driver, and no task holds a matrix: rows are spread as (row, atom, value).

Defined cases: statements that are null or no terms have no equations; rows that share seq and name are told apart by
nothing, so give each declaration its own seq; an empty corpus gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.functions import dimensions, terms
from stratia.functions.numbering import numbered
from stratia.operators.statements import spread
from stratia.session import checkpoint, materialize, scratch

#: Rounds after which a phase gives up; forwards a round settles at least one atom.
MOST_ROUNDS = 10_000
#: Rows that a task holds; blocks are done again if at most so much of the rows remained.
BLOCK, SHRUNK = 2_000, 0.7
WHOLE = "decimal(38,0)"


def _statements(decls: DataFrame, run_one, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """(seq, name, fields) of each declaration; each distinct statement is read once, however many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(1 + len(fields))]
            for stmt in b.column(0).to_pylist():
                try:
                    found = dimensions.Statement(terms.parse(stmt), *run_one.options).rows
                except terms.TermError:
                    found = []
                for values in run_one(found):
                    for column, v in zip(out, (stmt, *values), strict=True):
                        column.append(v)
            kinds = [pa.string(), *(t for _, t in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["stmt", *(n for n, _ in fields)])

    rows = decls.filter("stmt is not null").select(F.col("seq").cast("long"), "name", "stmt")
    made = spread(rows.select("stmt").distinct()).mapInArrow(run, "stmt string, " + schema)
    return rows.join(made.hint("merge"), "stmt").select("seq", "name", *(n for n, _ in fields))


def equations(decls: DataFrame, keying: str = "fine", literals: str = "dimensionless") -> DataFrame:
    """(seq, name, row, atom, local, num, den): all equations of each statement, rows numbered from 0."""

    def each(rows):
        for i, row in enumerate(rows):
            for (local, key), v in sorted(row.items()):
                yield i, key, local, Decimal(v.numerator), Decimal(v.denominator)

    each.options = (keying, literals)
    whole = pa.decimal128(38, 0)
    return _statements(decls, each, [("row", pa.int32()), ("atom", pa.string()), ("local", pa.bool_()), ("num", whole), ("den", whole)], f"row int, atom string, local boolean, num {WHOLE}, den {WHOLE}")


def constraints(decls: DataFrame, keying: str = "fine", literals: str = "dimensionless") -> DataFrame:
    """(seq, name, row, form, entries): what each statement says of global atoms, in whole numbers; equal rows have equal forms.

    Local atoms are eliminated inside a statement, which is exact, as no other statement has them.
    """

    def each(rows):
        for i, row in enumerate(map(dimensions.primitive, dimensions.without_locals(rows))):
            yield i, ";".join(f"{len(k)}:{k}^{v}" for k, v in row.items()), [{"atom": k, "v": Decimal(v)} for k, v in row.items()]

    each.options = (keying, literals)
    entry = pa.list_(pa.struct([("atom", pa.string()), ("v", pa.decimal128(38, 0))]))
    return _statements(decls, each, [("row", pa.int32()), ("form", pa.string()), ("entries", entry)], f"row int, form string, entries array<struct<atom: string, v: {WHOLE}>>")


def _sure(c: Column) -> Column:
    """c, or an error where it does not fit (null, if the session does not raise by itself)."""
    return F.coalesce(c, F.raise_error(F.lit("a dimension needs more digits than a whole decimal has")).cast(WHOLE))


def _times(a: Column, b: Column) -> Column:
    return _sure((a * b).cast(WHOLE))


def _over(a: Column, b: Column) -> Column:
    """The quotient of whole decimals of which b divides a."""
    q = F.call_function("div", a, b).cast(WHOLE)
    return _sure(F.when((q * b).cast(WHOLE) == a, q))


def _total(c: Column) -> Column:
    return _sure(F.sum(c).cast(WHOLE))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole decimals, by Euclid's steps; 184 are enough for 38 digits."""
    one, whole = F.lit(1).cast(WHOLE), lambda c: F.abs(c).cast(WHOLE)
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, one).otherwise(s["b"])).cast(WHOLE).alias("b")))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(184)), F.struct(whole(a).alias("a"), whole(b).alias("b")), step, lambda s: s["a"])
    return F.when((F.abs(a) == 1) | (F.abs(b) == 1), one).otherwise(steps)


def lcm(a: Column, b: Column) -> Column:
    return _times(_over(a, gcd(a, b)), b)


def fold(values: Column, how) -> Column:
    """Whole decimals folded by gcd from 0, or by lcm from 1; one value alone needs no steps."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.aggregate(values, F.lit(0 if how is gcd else 1).cast(WHOLE), lambda s, x: how(s, x).cast(WHOLE)))


class _Rows:
    """Rows as entries in written parts; each row counts in its last part alone."""

    def __init__(self, entries: DataFrame):
        self.spark, self.paths, self.schema = entries.sparkSession, [], None
        self.add(entries)

    def add(self, entries: DataFrame) -> DataFrame:
        path = scratch(self.spark, "dimension-rows")
        out = entries.select("rid", F.lit(len(self.paths)).alias("part"), "atom", F.col("v").cast(WHOLE).alias("v"))
        self.schema = self.schema or out.schema
        out.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def whole(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def now(self, leads: DataFrame) -> DataFrame:
        """(rid, atom, v) of the rows in leads, without their common factors."""
        held = self.whole().join(leads.select("rid", "part", "g"), ["rid", "part"])
        return held.select("rid", "atom", F.when(F.col("g") == 1, F.col("v")).otherwise(_over(F.col("v"), F.col("g"))).alias("v"))


def _leads(entries: DataFrame) -> DataFrame:
    """(rid, part, lead, p, g): each row's first atom, its value, and the common factor that is divided out."""
    found = entries.groupBy("rid", "part").agg(F.min(F.struct("atom", "v")).alias("m"), F.collect_set(F.abs("v").cast(WHOLE)).alias("values"))
    found = found.select("rid", "part", "m", F.when(F.array_contains("values", F.lit(1).cast(WHOLE)), F.lit(1).cast(WHOLE)).otherwise(fold(F.col("values"), gcd)).alias("g"))
    return found.select("rid", "part", F.col("m.atom").alias("lead"), _over(F.col("m.v"), F.col("g")).alias("p"), "g")


BLOCKED = f"rid struct<seq: bigint, row: int>, entries array<struct<atom: string, v: {WHOLE}>>"


def _in_task(change, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (rid, entries) of a block, in order, changed in whole numbers."""
    rows = sorted(((r["seq"], r["row"]), {e["atom"]: int(e["v"]) for e in entries}) for r, entries in zip(pdf["rid"], pdf["entries"], strict=True))
    out = change(rows)
    if any(abs(v) >= 10**38 for _, row in out for v in row.values()):
        raise OverflowError("a dimension needs more digits than a whole decimal has")
    return pd.DataFrame({"rid": [{"seq": n[0], "row": n[1]} for n, _ in out], "entries": [[{"atom": k, "v": Decimal(v)} for k, v in sorted(row.items())] for _, row in out]})


def _blocks(rows: DataFrame) -> DataFrame:
    """(rid, entries) of rows that others before them in their block do not imply."""
    rows, n = materialize(rows, "dimension-blocks"), 0
    while (left := rows.count()) > 1 and BLOCK > 1 and (not n or left <= SHRUNK * n):
        placed = numbered(rows, "rid").withColumn("block", F.floor(F.col("i") / BLOCK))
        rows = materialize(placed.groupBy("block").applyInPandas(lambda pdf: _in_task(dimensions.independent, pdf), BLOCKED), "dimension-blocks")
        if left <= BLOCK:
            break
        n = left
    return rows


def _combined(now: DataFrame, scale: DataFrame, takes: DataFrame) -> DataFrame:
    """Rows rid of scale (rid, times), multiplied, minus `less` times the rows `by` of takes (rid, by, less), without zeros."""
    own = now.join(scale.select("rid", "times"), "rid").select("rid", "atom", _times(F.col("v"), F.col("times")).alias("v"))
    other = now.withColumnRenamed("rid", "by").join(takes, "by").select("rid", "atom", _times(-F.col("v"), F.col("less")).alias("v"))
    return own.union(other).groupBy("rid", "atom").agg(_total("v").alias("v")).filter("v <> 0")


def solve(constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, reduced) of rows (seq, name, row, form, entries).

    verdicts: (seq, name, row, verdict), "implied" by rows before it in the order of seq and row, or "independent".
    reduced: (pivot, atom, num, den), the reduced row echelon form by the order of the atoms: pivot = minus the sum of
    num / den times each other atom; the pivot's own entry is one.
    """
    rows = materialize(constraints.withColumn("rid", F.struct("seq", "row")), "dimension-constraints")
    kept = materialize(rows.groupBy("form").agg(F.min("rid").alias("rid")), "dimension-forms")
    held = _Rows(_blocks(rows.join(kept, ["form", "rid"]).select("rid", "entries")).select("rid", F.explode("entries").alias("e")).select("rid", "e.atom", "e.v"))
    leads = checkpoint(_leads(held.whole()))
    for _ in range(MOST_ROUNDS):
        first = leads.groupBy("lead").agg(F.min(F.struct("rid", "p")).alias("m"), F.count("*").alias("n")).filter("n > 1").select("lead", F.col("m.rid").alias("by"), F.col("m.p").alias("q"))
        behind = leads.join(first, "lead").filter("rid <> by").withColumn("g", gcd(F.col("p"), F.col("q")))
        behind = checkpoint(behind.select("rid", "by", _over(F.col("q"), F.col("g")).alias("times"), _over(F.col("p"), F.col("g")).alias("less")))
        if behind.isEmpty():
            break
        changed = held.add(_combined(held.now(leads), behind, behind.select("rid", "by", "less")))
        leads = checkpoint(leads.join(behind.select("rid"), "rid", "left_anti").union(_leads(changed)))
    else:
        raise RuntimeError(f"dimensions did not settle in {MOST_ROUNDS} rounds")
    verdicts = rows.select("seq", "name", "row", "rid").join(leads.select("rid", F.lit("independent").alias("verdict")), "rid", "left")
    return verdicts.select("seq", "name", "row", F.coalesce("verdict", F.lit("implied")).alias("verdict")), _reduced(held, leads)


def _reduced(held: _Rows, leads: DataFrame) -> DataFrame:
    if leads.count() <= BLOCK:
        rows = held.now(leads).groupBy("rid").agg(F.collect_list(F.struct("atom", "v")).alias("entries"))

        def form(rows):
            return [((0, i), row) for i, row in enumerate(dimensions.reduced_form([row for _, row in rows]))]

        done = rows.groupBy(F.lit(0).alias("block")).applyInPandas(lambda pdf: _in_task(form, pdf), BLOCKED).select("rid", F.explode("entries").alias("e"))
        held = _Rows(done.select("rid", "e.atom", "e.v"))
        leads = checkpoint(_leads(held.whole()))
    for _ in range(MOST_ROUNDS):
        now = held.now(leads)
        heads = leads.select(F.col("rid").alias("by"), F.col("lead").alias("atom"), F.col("p").alias("q"))
        hits = now.join(heads, "atom").filter("rid <> by").select("rid", "by", F.col("v").alias("a"), "q", _over(F.abs("q").cast(WHOLE), gcd(F.col("v"), F.col("q"))).alias("m"))
        hits = checkpoint(hits)
        if hits.isEmpty():
            break
        scale = checkpoint(hits.groupBy("rid").agg(F.collect_set("m").alias("ms")).select("rid", fold(F.col("ms"), lcm).alias("times")))
        takes = hits.join(scale, "rid").select("rid", "by", _over(_times(F.col("a"), F.col("times")), F.col("q")).alias("less"))
        changed = held.add(_combined(now, scale, takes))
        leads = checkpoint(leads.join(scale.select("rid"), "rid", "left_anti").union(_leads(changed)))
    else:
        raise RuntimeError(f"dimensions did not settle in {MOST_ROUNDS} rounds")
    out = held.now(leads).join(leads.select("rid", "lead", "p"), "rid").withColumn("g", gcd(F.col("v"), F.col("p")))
    sign = F.when(F.col("p") < 0, F.lit(-1)).otherwise(F.lit(1)).cast(WHOLE)
    return out.select(F.col("lead").alias("pivot"), "atom", _times(_over(F.col("v"), F.col("g")), sign).alias("num"), _over(F.abs("p").cast(WHOLE), F.col("g")).alias("den"))


def implied(asked: DataFrame, reduced: DataFrame) -> DataFrame:
    """(seq, name, row, implied): whether the reduced form of other rows implies each row of `asked`, as constraints() gives them.

    A reduced form has no pivot but its own in a row, so a row is done in one step: what remains on each atom is its own value
    minus, for each pivot in it, the pivot's value times the entry. Fractions of a row are brought to one denominator.
    """
    rows = asked.withColumn("rid", F.struct("seq", "row"))
    entries = checkpoint(rows.select("rid", F.explode("entries").alias("e")).select("rid", "e.atom", "e.v"))
    found = entries.select("rid", F.col("atom").alias("pivot"), "v").join(reduced, "pivot").select("rid", "atom", _times(-F.col("v"), F.col("num")).alias("v"), "den")
    parts = checkpoint(entries.select("rid", "atom", "v", F.lit(1).cast(WHOLE).alias("den")).union(found))
    scale = parts.groupBy("rid").agg(F.collect_set("den").alias("ds")).select("rid", fold(F.col("ds"), lcm).alias("times"))
    left = parts.join(scale, "rid").groupBy("rid", "atom").agg(_total(_times(F.col("v"), _over(F.col("times"), F.col("den")))).alias("v")).filter("v <> 0").select("rid").distinct()
    return rows.select("seq", "name", "row", "rid").join(left.withColumn("more", F.lit(True)), "rid", "left").select("seq", "name", "row", F.col("more").isNull().alias("implied"))
