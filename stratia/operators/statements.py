"""Statements as DataFrames: parsing, erasure, equivalence, postings, similarity, edits, dictionaries.

Terms are parsed inside tasks and travel as their encodings. What compares many statements is joins and groups on
those encodings; Python sees one statement, or one candidate pair, at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.functions import pairs as together
from stratia.functions import terms
from stratia.functions.numbering import numbered, running
from stratia.operators.graph import check_choice
from stratia.session import materialize, shuffle_partitions

#: Nodes that a shared subterm needs to be a key: closed, open, and of a shape.
CLOSED, OPEN, SHAPE = 3, 5, 8
#: Weights of a similarity's factors (fixed values of the ranking), and the least shared nodes and score.
RARITY, OTHER_THEORY, SCOPED, DERIVED = 0.5, 0.15, 0.30, 0.45
LEAST_COMMON, LEAST_SCORE = 6, 0.30
#: Representatives of a key that one task joins; keys of more are dealt out in chunks.
CHUNK = 512
#: Blocks of terms that a stated set of queries meets.
BLOCKS = 64

PARSED = "seq long, name string, kind string, module string, root string, size int, concrete int, closed boolean, concludes string, heads array<string>, symbols array<string>, requires array<string>, rigid string, slots array<string>, binders array<string>, carriers array<boolean>, type_former boolean"


def parse(decls: DataFrame) -> DataFrame:
    """One row for each statement that parses (others are left out, as declarations without one are)."""
    rows = decls.filter("stmt is not null").select("seq", "name", "kind", "module", "stmt")
    return rows.join(_read(rows).hint("merge"), "stmt").select([f.name for f in T._parse_datatype_string(PARSED)])


def collapsed(decls: DataFrame) -> DataFrame:
    """parse() of one row for each distinct statement, its first by seq, with how many declarations have it (copies) and stmt."""
    firsts = decls.filter("stmt is not null").groupBy("stmt").agg(F.min(F.struct("seq", "name", "kind", "module")).alias("f"), F.count("*").alias("copies"))
    fields = [f.name for f in T._parse_datatype_string(PARSED)]
    return firsts.select("stmt", "copies", "f.*").join(_read(firsts).hint("merge"), "stmt").select(*fields, "copies", "stmt")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all tasks: distinct terms are few bytes, which would else be read by one task, and much work."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def _read(rows: DataFrame) -> DataFrame:
    """(stmt, what its term says) of the distinct statements that parse, each read once, however many declarations have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stmt in b.column(0).to_pylist():
                try:
                    t = terms.parse(stmt)
                except terms.TermError:
                    continue
                skeleton, slots = terms.rigid(t)
                binders, former = terms.signature(t)
                values = (stmt, terms.render(t), terms.size(t), terms.concrete(t), terms.loose(t) == 0, terms.render(terms.conclusion(t)), terms.application_heads(t), terms.symbols(t), terms.requires(t), terms.render(skeleton), slots, [x for x, _ in binders], [c for _, c in binders], former)
                out.append(dict(zip(SCHEMA.names, values, strict=True)))
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return spread(rows.select("stmt").distinct()).mapInArrow(run, "stmt string, " + PARSED[PARSED.index("root") :])


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
SCHEMA = pa.schema([("stmt", _S), ("root", _S), ("size", _I), ("concrete", _I), ("closed", _B), ("concludes", _S), ("heads", pa.list_(_S)), ("symbols", pa.list_(_S)), ("requires", pa.list_(_S)), ("rigid", _S), ("slots", pa.list_(_S)), ("binders", pa.list_(_S)), ("carriers", pa.list_(_B)), ("type_former", _B)])


def signatures(parsed: DataFrame) -> DataFrame:
    """(sym, binders, carriers, type_former) of each declaration; of repeated names the last."""
    last = Window.partitionBy("name").orderBy(F.col("seq").desc())
    return parsed.withColumn("n", F.row_number().over(last)).filter("n = 1").select(F.col("name").alias("sym"), "binders", "carriers", "type_former")


def erased(parsed: DataFrame, level: str, column: str = "erased", of: str = "root") -> DataFrame:
    """parsed with the root (or another column of terms, as `concludes`) at a level of erasure."""
    check_choice(level, terms.LEVELS, "level")
    if level == "exact":
        return parsed.withColumn(column, F.col(of))
    return _by_signatures(parsed, column, of, lambda t, known: terms.erase(t, level, known))


def explicit(parsed: DataFrame, column: str = "explicit", of: str = "root") -> DataFrame:
    """parsed with its terms' implicit and instance arguments dropped, by the telescopes of the heads that take them."""
    return _by_signatures(parsed, column, of, terms.drop_implicit)


def _by_signatures(parsed: DataFrame, column: str, of: str, change) -> DataFrame:
    """parsed with its terms changed, each distinct one once.

    A term brings the signatures of its own heads, joined by name, so that no task holds the table of all signatures.
    """
    roots = parsed.groupBy(F.col(of).alias("_term")).agg(F.first("heads").alias("heads")) if of == "root" else parsed.select(F.col(of).alias("_term"), F.explode("heads").alias("h")).groupBy("_term").agg(F.collect_set("h").alias("heads"))
    needed = roots.select("_term", F.explode("heads").alias("sym")).join(signatures(parsed).hint("merge"), "sym")
    given = needed.groupBy("_term").agg(F.collect_list(F.struct("sym", "binders", "carriers", "type_former")).alias("sigs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for term, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known = {s["sym"]: (list(zip(s["binders"], s["carriers"], strict=True)), s["type_former"]) for s in sigs or []}
                out.append(terms.render(change(terms.parse("x-stmt-v1;" + term), known)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_term", column])

    # Rows of repeated terms are few bytes when they are stored, so that sizes of files must not choose what goes to all tasks.
    made = spread(roots.join(given.hint("merge"), "_term", "left").select("_term", "sigs")).mapInArrow(run, f"_term string, {column} string")
    return parsed.join(made.hint("merge"), F.col(of) == F.col("_term")).drop("_term")


def is_prop(kind: Column, concludes: Column) -> Column:
    """Whether a declaration states a proposition: a theorem, an axiom, or with Prop as its conclusion's sort."""
    return kind.isin("theorem", "axiom") | (concludes == "s(0)")


def classes(rows: DataFrame, canon: str = "erased", least: int = 2) -> DataFrame:
    """(canon, n, first, members): rows that share a canonical form; members is a sum of digests of their names.

    A class is a partial sum and no list, however many rows it has; membership() gives its rows.
    """
    digest = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 6), 16, 10).cast("long")
    found = rows.groupBy(canon).agg(F.count("*").alias("n"), F.min(F.struct("seq", "name"))["name"].alias("first"), F.sum(digest).alias("members"))
    return found.filter(F.col("n") >= least)


def membership(rows: DataFrame, canon: str = "erased", least: int = 2) -> DataFrame:
    """(name, first, n): each row with the first member and the size of its class."""
    found = classes(rows, canon, least).select(canon, "first", "n")
    return rows.select(canon, "name").join(found, canon).select("name", "first", "n")


def equivalent(rows: DataFrame, canon: str = "erased") -> DataFrame:
    """(name, first, n): propositions that share a canonical form with others, by their class; pairs are not spelled out."""
    return membership(rows.filter(is_prop(F.col("kind"), F.col("concludes"))), canon)


def subterms(parsed: DataFrame, column: str = "root") -> DataFrame:
    """(name, key, size, closed): the distinct subterms of each row's term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, terms.render(t), terms.size(t), terms.loose(t) == 0) for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in dict.fromkeys(terms.walk(terms.parse("x-stmt-v1;" + r)))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (_S, _S, _I, _B), strict=True)], names=["name", "key", "size", "closed"])

    return parsed.select("name", column).mapInArrow(run, "name string, key string, size int, closed boolean")


def postings(keys: DataFrame, total: int) -> DataFrame:
    """(key, n, size, idf): how many declarations have a key, of all keys; (name, key) are distinct.

    copies, where keys have it: how many declarations a row stands for.
    """
    n = F.sum("copies") if "copies" in keys.columns else F.count("*")
    found = keys.groupBy("key").agg(n.alias("n"), F.max("size").alias("size"))
    return found.withColumn("idf", F.log(F.lit(float(total)) / F.col("n")))


def symbol_frequency(parsed: DataFrame) -> DataFrame:
    """(sym, df): declarations whose statement has a symbol."""
    return parsed.select("name", F.explode(F.array_distinct("symbols")).alias("sym")).groupBy("sym").agg(F.count("*").alias("df"))


def motifs(posted: DataFrame, least_family: int = 3, least_size: int = 6, top: int = 40) -> DataFrame:
    """Keys by size times the logarithm of their family."""
    kept = posted.filter((F.col("n") >= least_family) & (F.col("size") >= least_size))
    return kept.withColumn("weight", F.col("size") * F.log(F.col("n") + 1.0)).orderBy(F.col("weight").desc(), "key").limit(top)


def closure(parsed: DataFrame, prefix: str = "") -> DataFrame:
    """(sym, known, df): of the heads of statements in modules of a prefix, which have a signature."""
    heads = parsed.filter(F.col("module").startswith(prefix)).select("name", F.explode("heads").alias("sym")).groupBy("sym").agg(F.count("*").alias("df"))
    known = parsed.select(F.col("name").alias("sym")).distinct().withColumn("known", F.lit(True))
    return heads.join(known, "sym", "left").select("sym", F.coalesce("known", F.lit(False)).alias("known"), "df")


def representatives(rows: DataFrame) -> DataFrame:
    """(name, root, erased, shape, n): one row for each distinct root, with its first name and how many rows have it.

    rows: name, root, erased, shape, and symbols, if they are to go along; names are unique and equal roots have equal erasures.
    """
    more = [F.first("symbols").alias("symbols")] if "symbols" in rows.columns else []
    return rows.groupBy("root").agg(F.min("name").alias("name"), F.min("erased").alias("erased"), F.min("shape").alias("shape"), F.count("*").alias("n"), *more)


def sources(reps: DataFrame) -> DataFrame:
    """(name, key): the keys of the three sources of candidates, of each its own.

    A: the shape; B: subterms of at least CLOSED nodes, open ones of OPEN; C: subterms of the shape of at least SHAPE.
    """
    tagged = lambda df, tag: df.select("name", F.concat(F.lit(tag), "key").alias("key"))
    b = subterms(reps).filter(F.col("size") >= F.when(F.col("closed"), CLOSED).otherwise(OPEN))
    c = subterms(reps, "shape").filter(F.col("size") >= SHAPE)
    return tagged(reps.select("name", F.col("shape").alias("key")), "A").union(tagged(b, "B")).union(tagged(c, "C"))


def members(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, name): each row's class by the name of its representative."""
    return rows.select("root", "name").join(reps.select("root", F.col("name").alias("class")), "root").select("class", "name")


def weighed(keys: DataFrame, reps: DataFrame, total: int) -> DataFrame:
    """(name, key, idf) of representatives: all keys, by how many declarations (not classes) have them."""
    found = keys.select("name", "key").join(reps.select("name", "n"), "name")
    idf = found.groupBy("key").agg(F.log(F.lit(float(total)) / F.sum("n")).alias("idf"))
    return found.join(idf, "key").select("name", "key", "idf")


def meetings(keys: DataFrame, chunk: int | None = None) -> DataFrame:
    """(name, other, rarity): all pairs name <= other of representatives that share a key, each with itself too.

    keys: (name, key, idf). A key of over `chunk` (CHUNK) representatives is dealt out as pairs of chunks, so that no task
    holds all of one; none is dropped.
    """
    chunks = keys.groupBy("key").agg(F.ceil(F.count("*") / (chunk or CHUNK)).alias("chunks"))
    dealt = keys.join(chunks, "key").withColumn("i", F.pmod(F.xxhash64("name"), "chunks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    a = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "name", "idf")
    b = a.select("key", "lo", "hi", F.col("i").alias("k"), F.col("name").alias("other"))
    met = a.join(b, ["key", "lo", "hi"]).filter("name <= other and (lo = hi or i <> k)")
    return met.groupBy("name", "other").agg(F.max("idf").alias("rarity"))


def meetings_between(a: DataFrame, b: DataFrame, chunk: int | None = None) -> DataFrame:
    """(name, other): pairs of a row of a and one of b that share a key, each (name, key); large keys go in chunks."""
    dealt = {}
    for side, df in (("i", a), ("j", b)):
        dealt[side] = df.groupBy("key").agg(F.ceil(F.count("*") / (chunk or CHUNK)).alias(f"{side}_chunks"))
    sizes = dealt["i"].join(dealt["j"], "key")
    place = lambda side: F.pmod(F.xxhash64("name"), f"{side}_chunks").alias(side)
    over = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_chunks") - 1)).alias(side)
    left = a.join(sizes, "key").select("key", place("i"), over("j"), "name")
    right = b.join(sizes, "key").select("key", over("i"), place("j"), F.col("name").alias("other"))
    return left.join(right, ["key", "i", "j"]).select("name", "other").distinct()


def tiles(keys: DataFrame, reps: DataFrame, *carried: str, chunk: int | None = None) -> DataFrame:
    """(g, lo, hi, key, i, name, ranks, ...): representatives dealt out so that each pair that shares a key meets in one group.

    keys: (name, key, idf); carried: columns of reps. Keys have numbers in the order of idf, the rarest last, and a pair counts where
    the key is the last that both have, which _met() tells. A key of over `chunk` (CHUNK) representatives is dealt out
    as pairs of chunks; smaller ones share groups.
    """
    chunk = chunk or CHUNK
    shared_ = materialize(keys.groupBy("key").agg(F.max("idf").alias("idf"), F.count("*").alias("c")).filter("c > 1"), "keys")
    placed = materialize(numbered(shared_, "idf", "key", column="r"), "keys")
    bins = max(1, -(-(shared_.filter(F.col("c") <= chunk).agg(F.sum("c")).first()[0] or 0) // chunk))
    named = materialize(keys.select("name", "key").join(placed, "key").select("name", "r", "idf", F.ceil(F.col("c") / chunk).alias("chunks")), "ranks")
    ranks = named.groupBy("name").agg(F.sort_array(F.collect_list("r")).alias("ranks"))
    whole = reps.select("name", *carried).join(ranks.hint("merge"), "name")
    dealt = named.withColumn("i", F.pmod(F.xxhash64("name"), "chunks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    g = F.when(F.col("chunks") == 1, -1 - F.pmod("r", F.lit(bins))).otherwise(F.col("r")).alias("g")
    spots = dealt.select(g, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("r").alias("key"), "idf", "i", "name")
    # Groups are few bytes and much work, so that sizes must not choose how many tasks read them.
    return spots.join(whole.hint("merge"), "name").repartition(4 * shuffle_partitions(keys.sparkSession), "g", "lo", "hi").groupBy("g", "lo", "hi")


def _met(pdf: pd.DataFrame) -> Iterator[tuple[float, pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """Of each key in a group of tiles(): (idf, rows, others, which of them meet here), each pair one way."""
    for key, rows in pdf.sort_values(["key", "name"], kind="stable").groupby("key"):
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        a, b = rows[rows["i"] == lo], rows[rows["i"] == hi]
        met = np.triu(np.ones((len(a), len(b)), bool), 1) if lo == hi else np.ones((len(a), len(b)), bool)
        later: tuple[dict, dict] = ({}, {})
        for held, side in zip(later, (a, b), strict=True):
            for at, ranks in enumerate(side["ranks"]):
                for r in ranks[np.searchsorted(ranks, key, "right") :]:
                    held.setdefault(r, []).append(at)
        for r, at in later[0].items():
            if r in later[1]:
                met[np.ix_(at, later[1][r])] = False
        if met.any():
            yield float(rows["idf"].iloc[0]), a, b, met


def _measured(c: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> dict[str, np.ndarray]:
    """The ratios of terms.scores from shared nodes and both sizes."""
    most = np.maximum(a, b)
    retention = np.where(most > 0, c / np.maximum(most, 1), same.astype(float))
    other = lambda x: np.where(most > 0, c / np.maximum(x, 1), retention)
    return {
        "retention": retention, "min_normalised": other(np.minimum(a, b)), "dice": np.where(most > 0, 2 * c / np.maximum(a + b, 1), retention),
        "jaccard": other(a + b - c), "geometric_mean": other(np.sqrt(a * b)),
    }


def nearest_classes(keys: DataFrame, reps: DataFrame, total: int, score: str = "retention", most: int = 11) -> DataFrame:
    """What compare_classes() gives for all pairs that share a key, less those that `most` others of a row outrank in its group.

    rank() over the result has the same first `most` rows as over all pairs. Groups compare their rows as matrices.
    """
    check_choice(score, MEASURES, "score")
    fields = "name string, other string, rarity double, n long, " + ", ".join(f"{m} {'int' if i < 5 else 'double'}" for i, m in enumerate(MEASURES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rarity, a, b, met in _met(pdf):
            x, y = a["erased"].tolist(), b["erased"].tolist()
            c, n, scoped, left, right = together.compared(x, y, together.counted)
            same = np.array(x, object)[:, None] == np.array(y, object)[None, :]
            ratios = _measured(c, left[:, None], right[None, :], same)
            value = {"common": c, "vars": n, "scoped": scoped, "left": left[:, None] + 0 * c, "right": right[None, :] + 0 * c, **ratios}
            factor = (1 + RARITY * min(rarity / max(math.log(max(total, 2)), 1e-9), 1.0)) * (1 - SCOPED * scoped / np.maximum(n, 1))
            worth = np.round(value[score] * factor, 9)
            fine = met & (c >= LEAST_COMMON) & (value[score] >= LEAST_SCORE)
            for turned in (False, True):
                names, others, sizes = (b["name"], a["name"], a["n"]) if turned else (a["name"], b["name"], b["n"])
                names, others, sizes = names.to_numpy(), others.to_numpy(), sizes.to_numpy()
                side = {k: v.T for k, v in value.items()} if turned else value
                ok, w = (fine.T, worth.T) if turned else (fine, worth)
                rows, columns = [], []
                for i in np.flatnonzero(ok.any(1)):
                    at = np.flatnonzero(ok[i])  # in the order of names
                    at = at[np.lexsort((at, side["vars"][i, at], -side["common"][i, at], -w[i, at]))[:most]]
                    rows += [i] * len(at)
                    columns += at.tolist()
                swap = {"left": "right", "right": "left"} if turned else {}
                picked = {m: side[swap.get(m, m)][rows, columns] for m in MEASURES}
                out.append(pd.DataFrame({"name": names[rows], "other": others[columns], "rarity": rarity, "n": sizes[columns], **picked}))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])

    own = keys.groupBy("name").agg(F.max("idf").alias("rarity")).select("name", F.col("name").alias("other"), "rarity")
    return compare_classes(own, reps).unionByName(tiles(keys, reps, "erased", "n").applyInPandas(run, fields))


def best_measures(keys: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, n, best of each ratio and of common): compare_classes() over all pairs that share a key and LEAST_COMMON nodes, summed up.

    n: how many rows those of a class share so many with, its other members among them. Groups sum up their pairs as matrices, so
    that no pair is a row.
    """
    ratios = MEASURES[5:]
    fields = "name string, n long, " + ", ".join(f"{m} double" for m in ratios) + ", common int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, a, b, met in _met(pdf):
            x, y = a["erased"].tolist(), b["erased"].tolist()
            c, _, _, left, right = together.compared(x, y, together.counted, False)
            value = _measured(c, left[:, None], right[None, :], np.array(x, object)[:, None] == np.array(y, object)[None, :]) | {"common": c}
            fine = met & (c >= LEAST_COMMON)
            for rows, others, turn in ((a, b, lambda m: m), (b, a, lambda m: m.T)):
                hit = turn(fine)
                some = hit.any(1)
                sums = {"name": rows["name"].to_numpy()[some], "n": (hit[some] * others["n"].to_numpy()[None, :]).sum(1)}
                out.append(pd.DataFrame(sums | {m: np.where(hit, turn(v), -1.0).max(1)[some] for m, v in value.items()}))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])

    own = reps.filter("n > 1").select("name", F.col("name").alias("other"), F.lit(None).cast("double").alias("rarity"))
    with_self = compare_classes(own, reps).filter(F.col("common") >= LEAST_COMMON).select("name", "n", *ratios, "common")
    parts = tiles(keys, reps, "erased", "n").applyInPandas(run, fields).unionByName(with_self)
    return parts.groupBy(F.col("name").alias("class")).agg(F.sum("n").alias("n"), *(F.max(m).alias(m) for m in (*ratios, "common")))


def compare_classes(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(name, other, rarity, n, measures) in both directions from pairs name <= other of representatives.

    n: how many rows the other's class has besides the row itself; a class of one row does not meet itself.
    """
    a = reps.select("name", F.col("erased").alias("x"), F.col("n").alias("na"))
    b = reps.select(F.col("name").alias("other"), F.col("erased").alias("y"), F.col("n").alias("nb"))
    joined = pairs.filter("name < other").unionByName(pairs.filter("name = other").join(reps.filter("n > 1").select("name"), "name", "left_semi"))
    joined = joined.join(a, "name").join(b, "other").select("name", "other", "rarity", "na", "nb", "x", "y")
    fields = [f"{m} {'int' if i < 5 else 'double'}" for i, m in enumerate(MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = lru_cache(maxsize=1 << 15)(lambda t: terms.parse("x-stmt-v1;" + t))
        for b in batches:
            found = [terms.scores(parsed(x), parsed(y)) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array([f[m] for f in found], _I if i < 5 else pa.float64()) for i, m in enumerate(MEASURES))], names=["name", "other", "rarity", "na", "nb", *MEASURES])

    once = joined.mapInArrow(run, "name string, other string, rarity double, na long, nb long, " + ", ".join(fields))
    # Every measure but left and right is the same both ways, so that a pair is compared once.
    sides = F.explode(F.when(F.col("name") == F.col("other"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    turn = lambda c, d: F.when(F.col("turned"), F.col(d)).otherwise(F.col(c)).alias(c)
    n = F.when(F.col("name") == F.col("other"), F.col("nb") - 1).when(F.col("turned"), F.col("na")).otherwise(F.col("nb")).alias("n")
    swap = {"left": "right", "right": "left"}
    return once.withColumn("turned", sides).select(turn("name", "other"), turn("other", "name"), "rarity", n, *(turn(m, swap.get(m, m)) for m in MEASURES))


def rank_members(compared: DataFrame, membership: DataFrame, total: int, score: str = "retention", top: int = 10, others: DataFrame | None = None) -> DataFrame:
    """The `top` of each row, as rank() gives, from classes that were compared and (class, name).

    others: (class, name) of the rows that are ranked, where they are not the same.

    top + 1 rows by (score, name) lie in the top + 1 classes by (score, first name), and in each among its first
    top + 1 names; one more than `top`, as a row may be among them itself.
    """
    most = top + 1
    classes_ = rank(compared, total, score, most).drop("rank")
    place = F.row_number().over(Window.partitionBy("class").orderBy("name"))
    firsts = (membership if others is None else others).withColumn("place", place).filter(F.col("place") <= most).select(F.col("class").alias("other"), F.col("name").alias("member"))
    order = lambda by: Window.partitionBy(by).orderBy(F.round("total", 9).desc(), F.col("common").desc(), "vars", "member")
    heads = classes_.withColumnRenamed("name", "class").join(firsts, "other").withColumn("place", F.row_number().over(order("class"))).filter(F.col("place") <= most)
    each = membership.join(heads.drop("other", "place"), "class").filter("name <> member").drop("class")
    return each.withColumn("rank", F.row_number().over(order("name"))).filter(F.col("rank") <= top).withColumnRenamed("member", "other")


MEASURES = ("common", "vars", "scoped", "left", "right", "retention", "min_normalised", "dice", "jaccard", "geometric_mean")


def compare(pairs: DataFrame, rows: DataFrame, term: str = "erased", others: DataFrame | None = None) -> DataFrame:
    """pairs (name, other, ...) with the shared structure of the two terms; others: the rows of `other`, where they are not the same."""
    a = rows.select("name", F.col(term).alias("x"))
    b = (rows if others is None else others).select(F.col("name").alias("other"), F.col(term).alias("y"))
    joined = pairs.join(a.hint("merge"), "name").join(b.hint("merge"), "other")
    return joined.join(scored(spread(joined.select("x", "y").distinct())).hint("merge"), ["x", "y"]).drop("x", "y")  # equal terms are compared once


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) of terms with the measures of their shared structure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = lru_cache(maxsize=1 << 15)(lambda t: terms.parse("x-stmt-v1;" + t))
        for b in batches:
            found = [terms.scores(parsed(x), parsed(y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[m] for f in found], _I if i < 5 else pa.float64()) for i, m in enumerate(MEASURES))], names=["x", "y", *MEASURES])

    schema = "x string, y string, " + ", ".join(f"{m} {'int' if i < 5 else 'double'}" for i, m in enumerate(MEASURES))
    return pairs.select("x", "y").mapInArrow(run, schema)


def information(pairs: DataFrame, rows: DataFrame, frequency: DataFrame, total: int, term: str = "erased") -> DataFrame:
    """pairs (name, other) with info_weighted and info_dice: how much of two terms' information their shared part has.

    A term's information is the sum of log(total / df) over its names, repeats counted; a name of unknown frequency
    counts as one declaration's. frequency: (sym, df). Tasks count names, joins weigh them; equal pairs of terms go once.
    """
    a, b = rows.select("name", F.col(term).alias("x")), rows.select(F.col("name").alias("other"), F.col(term).alias("y"))
    joined = pairs.select("name", "other").join(a, "name").join(b, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("x", _S), ("y", _S), ("sym", _S), ("shared", _I), ("left", _I), ("right", _I)])
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, t = terms.parse("x-stmt-v1;" + x), terms.parse("x-stmt-v1;" + y)
                counts = [Counter(terms.symbols(u)) for u in (terms.generalise(s, t)[0], s, t)]
                out += [{"x": x, "y": y, "sym": k, "shared": counts[0][k], "left": counts[1][k], "right": counts[2][k]} for k in counts[1].keys() | counts[2].keys()]
            yield pa.RecordBatch.from_pylist(out, kind)

    named = joined.select("x", "y").distinct().mapInArrow(run, "x string, y string, sym string, shared int, left int, right int")
    weight = F.greatest(F.log(F.lit(float(max(total, 1))) / F.coalesce("df", F.lit(1))), F.lit(0.0))
    sides = ("shared", "left", "right")
    sums = named.join(frequency, "sym", "left").groupBy("x", "y").agg(*(F.sum(F.col(c) * weight).alias(c) for c in sides))
    known = joined.join(sums, ["x", "y"], "left").select("name", "other", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in sides))
    most, both = F.greatest("left", "right"), F.col("left") + F.col("right")
    ratio = lambda part, whole: F.when(whole <= 0, 0.0).otherwise(part / whole)
    return known.select("name", "other", ratio(F.col("shared"), most).alias("info_weighted"), ratio(2 * F.col("shared"), both).alias("info_dice"))


def information_by_class(keys: DataFrame, reps: DataFrame, frequency: DataFrame, total: int, term: str = "root") -> DataFrame:
    """(class, n, best and sum of info_weighted and info_dice): information() over all rows of classes that share a key with a class.

    n: how many rows, a class's other members among them. Groups sum up their pairs as matrices, so that no pair is a row.
    """
    weight = F.greatest(F.log(F.lit(float(max(total, 1))) / F.coalesce("df", F.lit(1))), F.lit(0.0)).alias("weight")
    names = reps.select("name", F.explode(F.array_distinct("symbols")).alias("sym")).join(frequency, "sym", "left")
    weights = names.groupBy("name").agg(F.collect_list(F.struct("sym", weight)).alias("weights"))
    held = materialize(reps.select("name", "n", F.col(term).alias("term")).join(weights.hint("merge"), "name", "left"), "weighed")
    measures = ("info_weighted", "info_dice")
    fields = "name string, n long, " + ", ".join(f"best_{m} double, sum_{m} double" for m in measures)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = {w["sym"]: w["weight"] for ws in pdf["weights"] if ws is not None for w in ws}
        for _, a, b, met in _met(pdf):
            c, _, _, left, right = together.compared(a["term"].tolist(), b["term"].tolist(), lambda tag, data: known[data[0]] if tag in "cj" else 0.0, False)
            most, both = np.maximum(left[:, None], right[None, :]), left[:, None] + right[None, :]
            ratios = {"info_weighted": np.where(most > 0, c / np.where(most > 0, most, 1), 0.0), "info_dice": np.where(both > 0, 2 * c / np.where(both > 0, both, 1), 0.0)}
            for rows, others, turn in ((a, b, lambda m: m), (b, a, lambda m: m.T)):
                hit, sizes = turn(met), others["n"].to_numpy()
                some = hit.any(1)
                sums = {"name": rows["name"].to_numpy()[some], "n": (hit * sizes[None, :]).sum(1)[some]}
                for m in measures:
                    v = turn(ratios[m])
                    sums |= {f"best_{m}": np.where(hit, v, -1.0).max(1)[some], f"sum_{m}": (np.where(hit, v, 0.0) * sizes[None, :]).sum(1)[some]}
                out.append(pd.DataFrame(sums))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])

    # A term shares all its information with itself.
    own = F.coalesce(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["weight"]), F.lit(0.0)) > 0
    with_self = held.filter("n > 1").select("name", (F.col("n") - 1).alias("n"), own.cast("double").alias("v"))
    with_self = with_self.select("name", "n", *(c for m in measures for c in (F.col("v").alias(f"best_{m}"), (F.col("v") * F.col("n")).alias(f"sum_{m}"))))
    parts = tiles(keys, held, "n", "term", "weights").applyInPandas(run, fields).unionByName(with_self)
    return parts.groupBy(F.col("name").alias("class")).agg(F.sum("n").alias("n"), *(f for m in measures for f in (F.max(f"best_{m}").alias(f"best_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"))))


def rank(compared: DataFrame, total: int, score: str = "retention", top: int = 10, theories: DataFrame | None = None, derivativeness: DataFrame | None = None) -> DataFrame:
    """The `top` of each query by the score and its factors, ties by shared nodes, variables and name."""
    check_choice(score, MEASURES, "score")
    out = compared.filter((F.col("common") >= LEAST_COMMON) & (F.col(score) >= LEAST_SCORE))
    out = out.withColumn("rarity", F.coalesce("rarity", F.lit(0.0))) if "rarity" in out.columns else out.withColumn("rarity", F.lit(0.0))
    factor = 1 + RARITY * F.least(F.col("rarity") / max(math.log(max(total, 2)), 1e-9), F.lit(1.0))
    factor = factor * (1 - SCOPED * F.col("scoped") / F.greatest(F.col("vars"), F.lit(1)))
    if theories is not None:
        for side, column in (("name", "ta"), ("other", "tb")):
            out = out.join(theories.select(F.col("name").alias(side), F.col("theory").alias(column)), side)
        factor = factor * F.when(F.col("ta") != F.col("tb"), 1 + OTHER_THEORY).otherwise(1.0)
    if derivativeness is not None:
        out = out.join(derivativeness.select(F.col("name").alias("other"), "derivativeness"), "other")
        factor = factor * (1 - DERIVED * F.col("derivativeness"))
    out = out.withColumn("total", F.col(score) * factor)
    # The order sees rounded totals, so that the last bits of floating sums don't decide ties.
    order = Window.partitionBy("name").orderBy(F.round("total", 9).desc(), F.col("common").desc(), "vars", "other")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def similar_brute(rows: DataFrame, queries: Column, top: int = 10) -> DataFrame:
    """(name, other, rank, measures): a stated set of queries against all rows, without candidates; ties by name.

    Each distinct term is compared once a query's term; queries go out in blocks, one to each part of the rows.
    """
    order = lambda by, name: Window.partitionBy(by).orderBy(F.round("retention", 9).desc(), name)
    asked = rows.filter(queries).select(F.col("erased").alias("x")).distinct()
    terms_ = rows.groupBy(F.col("erased").alias("y")).agg(F.min("name").alias("first"))
    fields = "x string, y string, first string, " + ", ".join(f"{m} {'int' if i < 5 else 'double'}" for i, m in enumerate(MEASURES))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])]
        right = right.sort_values("first", kind="stable")
        for at in range(0, len(left), CHUNK):
            for from_ in range(0, len(right), CHUNK):
                a, b = left["x"].to_numpy()[at : at + CHUNK], right.iloc[from_ : from_ + CHUNK]
                c, n, scoped, x, y = together.compared(list(a), b["y"].tolist(), together.counted)
                ratios = _measured(c, x[:, None], y[None, :], a[:, None] == b["y"].to_numpy()[None, :])
                value = {"common": c, "vars": n, "scoped": scoped, "left": x[:, None] + 0 * c, "right": y[None, :] + 0 * c, **ratios}
                i, j = np.nonzero((c >= LEAST_COMMON) & (ratios["retention"] >= LEAST_SCORE))
                i, j = (k[np.lexsort((j, -np.round(ratios["retention"][i, j], 9), i))] for k in (i, j))
                near = np.arange(len(i)) - np.searchsorted(i, i) <= top
                i, j = i[near], j[near]
                out.append(pd.DataFrame({"x": a[i], "y": b["y"].to_numpy()[j], "first": b["first"].to_numpy()[j], **{m: value[m][i, j] for m in MEASURES}}))
        return pd.concat(out[1:] or out)

    block = F.pmod(F.xxhash64("y"), F.lit(BLOCKS)).cast("int").alias("block")
    sides = [df.repartition(BLOCKS, "block").groupBy("block") for df in (asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))), terms_.select("*", block))]
    found = sides[0].cogroup(sides[1]).applyInPandas(run, fields)
    # top + 1 names lie in the top + 1 terms by (retention, first name), and in each among its first top + 1; one more for the query itself.
    found = found.withColumn("place", F.row_number().over(order("x", "first"))).filter(F.col("place") <= top + 1).drop("place", "first")
    place = Window.partitionBy("erased").orderBy("name")
    named = rows.select("name", "erased").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top + 1)
    met = found.join(named.select(F.col("name").alias("other"), F.col("erased").alias("y")), "y").withColumn("place", F.row_number().over(order("x", "other"))).filter(F.col("place") <= top + 1).drop("place", "y")
    out = rows.filter(queries).select("name", F.col("erased").alias("x")).join(met.hint("merge"), "x").drop("x").filter("name <> other")
    return out.withColumn("rank", F.row_number().over(order("name", "other"))).filter(F.col("rank") <= top)


def tied_rank(value: Column, by: Column | None = None) -> Column:
    """Rank from 0 to 1 in which equal values share the mean of their places."""
    whole = Window.partitionBy(by if by is not None else F.lit(0))
    order, peers = whole.orderBy(value), Window.partitionBy(*([by] if by is not None else []), value)
    return (F.rank().over(order) - 1 + (F.count("*").over(peers) - 1) / 2) / (F.greatest(F.count("*").over(whole), F.lit(2)) - 1)


def derivativeness(rows: DataFrame) -> DataFrame:
    """(name, derivativeness) from (name, proof, cited, mechanical): the mean of three ranks.

    proof: length of a proof (short ranks high); cited: how often a declaration is used (seldom ranks high);
    mechanical: the share of its uses that are constructors and recursors. Equal values are counted first, and a rank is a
    running sum over ranges of distinct values, so that no task holds them all.
    """
    n = F.greatest(F.lit(rows.count()), F.lit(2))

    def share(column: str, high: bool) -> DataFrame:
        counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
        placed = running(counts, "c", F.col("v").desc() if high else F.col("v"))
        place = (F.col("before") + (F.col("c") - 1) / 2) / (n - 1)
        return placed.select(F.col("v").alias(column), place.alias(f"{column}_rank"))

    out = rows
    for column, high in (("proof", True), ("cited", True), ("mechanical", False)):
        out = out.join(share(column, high), column)
    return out.select("name", ((F.col("proof_rank") + F.col("cited_rank") + F.col("mechanical_rank")) / 3).alias("derivativeness"))


def within_budget(keys: DataFrame, budget: int) -> DataFrame:
    """Of each query's keys (name, key, idf, n), rarest first, those that start before the postings reach a budget."""
    run = Window.partitionBy("name").orderBy(F.col("idf").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    return keys.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)).cast("long")).filter(F.col("before") < budget)


def _edits(pairs: DataFrame, most: int) -> DataFrame:
    edits = F.array_distinct(F.filter(F.arrays_zip("s", "t"), lambda x: x["s"] != x["t"]))
    pairs = pairs.withColumn("edits", F.sort_array(edits)).withColumn("n", F.size("edits"))
    return pairs.filter((F.col("n") > 0) & (F.col("n") <= most)).select("name", "other", "n", "edits")


def variants(parsed: DataFrame, most: int = 1, queries: DataFrame | None = None) -> DataFrame:
    """(name, other, n, edits): rows with one rigid skeleton that differ by few distinct replacements of names.

    Rows that differ by one replacement agree where neither of its two names stands. So each row goes out under its
    slots with the places of any one or two of its names masked, and only rows that agree there meet. With more
    replacements all rows of a skeleton meet.
    """
    a = parsed.select("rigid", "name", F.col("slots").alias("s"))
    a = a if queries is None else a.join(queries.select("name"), "name", "left_semi")
    b = parsed.select("rigid", F.col("name").alias("other"), F.col("slots").alias("t"))
    if most > 1:
        return _edits(a.join(b, "rigid").filter((F.col("name") != F.col("other")) & (F.size("s") == F.size("t"))), most)

    def masked(slots: str) -> Column:
        """Digests of the slots without the places of any one or two names."""
        own = F.array_distinct(slots)
        two = F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: y >= x), lambda y: F.transform(F.col(slots), lambda v: F.when((v != x) & (v != y), v)))))
        return F.array_distinct(F.transform(two, lambda key: F.xxhash64(F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"}))))

    left = a.select("rigid", "name", "s", F.explode(masked("s")).alias("key"))
    right = b.select("rigid", "other", "t", F.explode(masked("t")).alias("key"))
    met = left.join(right, ["rigid", "key"]).filter((F.col("name") != F.col("other")) & (F.size("s") == F.size("t")))
    return _edits(met, 1).dropDuplicates(["name", "other"])


def adjacent(members: DataFrame, found: DataFrame, top: int = 50) -> DataFrame:
    """(class, other, n, via): rows beside a class: variants of a member that are no members, by fewest edits.

    members: (class, name, seq); found: variants. Ties keep the first member.
    """
    out = members.join(found, "name").join(members.select("class", F.col("name").alias("other")), ["class", "other"], "left_anti")
    best = out.groupBy("class", "other").agg(F.min(F.struct("n", "seq", F.col("name").alias("via"))).alias("b")).select("class", "other", "b.n", "b.via")
    order = Window.partitionBy("class").orderBy("n", "other")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def adjacent_classes(found: DataFrame, names: DataFrame, top: int = 50) -> DataFrame:
    """adjacent() where a class's members are alike, so that the first of them stands for all: (via, other, n).

    found: variants among first members; names: (class, name) of all members, class being the first. The first `top` names of a
    class are enough for any ranking, so that classes meet and not their members.
    """
    place = F.row_number().over(Window.partitionBy("class").orderBy("name"))
    heads = names.withColumn("place", place).filter(F.col("place") <= top).select("class", F.col("name").alias("member"))
    met = found.select(F.col("name").alias("via"), F.col("other").alias("class"), "n").join(heads.hint("merge"), "class")
    order = Window.partitionBy("via").orderBy("n", "member")
    return met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("via", F.col("member").alias("other"), "n")


def vocabulary_adjacent(parsed: DataFrame, members: DataFrame, total: int, share: float = 0.05, top: int = 50) -> DataFrame:
    """(class, other, shared, rarest): rows that share symbols of at most max(total * share, 2) declarations with a class."""
    df = symbol_frequency(parsed).filter(F.col("df") <= max(math.floor(total * share), 2))
    has = parsed.select("name", F.explode(F.array_distinct("symbols")).alias("sym")).join(df, "sym")
    of = members.groupBy("name").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    kinds = has.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("sym", "df"))).alias("has")).join(of.hint("merge"), "name", "left")
    kinds = materialize(kinds, "kinds")
    mine = kinds.select("classes", "has").distinct().select(F.explode("classes").alias("class"), "has").select("class", F.explode("has.sym").alias("sym")).distinct()
    # Rows of the same classes and symbols rank by their names alone, so that the first of them are enough.
    place = F.row_number().over(Window.partitionBy("classes", "has").orderBy("name"))
    heads = kinds.withColumn("place", place).filter(F.col("place") <= top).select(F.col("name").alias("other"), "classes", F.explode("has").alias("h")).select("other", "classes", "h.sym", "h.df")
    out = mine.join(heads, "sym").filter(~F.coalesce(F.array_contains("classes", F.col("class")), F.lit(False)))
    out = out.groupBy("class", "other").agg(F.count("*").alias("shared"), F.min("df").alias("rarest"))
    order = Window.partitionBy("class").orderBy(F.col("shared").desc(), "rarest", "other")
    return out.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def ladder(parsed: DataFrame) -> DataFrame:
    """(name, exact, presentation, instances, carriers): members that each coarser level adds to a name's class."""
    props = parsed.filter(is_prop(F.col("kind"), F.col("concludes")))
    out, before = props.select("name", "seq"), F.lit(1)
    for level in terms.LEVELS[:-1]:
        rows = erased(parsed, level).join(props.select("seq"), "seq", "left_semi")
        sized = rows.join(rows.groupBy("erased").agg(F.count("*").alias(f"{level}_n")), "erased").select("seq", f"{level}_n")
        out = out.join(sized, "seq")
    for level in terms.LEVELS[:-1]:
        out, before = out.withColumn(level, F.col(f"{level}_n") - before), F.col(f"{level}_n")
    return out.select("name", *terms.LEVELS[:-1])


def dictionary(rows: DataFrame, left: Column, right: Column, per_left: int = 1, score: str = "retention") -> DataFrame:
    """(name, other, rank, total, ...): for each row of the left theory its best of the right one, by all three sources.

    The restriction to the theories comes before the comparison, not after the ranking.
    rows: name, root, erased, shape. Classes of either theory meet and are compared; members are ranked from them.
    """
    a, b = rows.filter(left), rows.filter(right)
    lefts, rights = (materialize(representatives(x), "representatives") for x in (a, b))
    compared = compare(meetings_between(sources(lefts), sources(rights)), lefts, others=rights)
    return rank_members(compared, members(a, lefts), 2, score, per_left, members(b, rights))


#: Candidates of a left row that filters by pairs may choose from.
POOL = 64


def registered(is_instance: Column) -> Column:
    """Whether a declaration is a registered instance; where that is unknown, it is not."""
    return F.coalesce(is_instance, F.lit(False))


def filtered_dictionary(rows: DataFrame, left: Column, right: Column, dropped: Column, cited: DataFrame | None = None, per_left: int = 1, pool: int = POOL, score: str = "retention") -> tuple[DataFrame, DataFrame]:
    """(found, missing): a dictionary without rows that `dropped` marks and without pairs of which one cites the other.

    dropped is over rows, as registered() and excluded_role() give it, null for rows that stay; it applies before rows are
    compared, so that no row that stays gives way to one that does not. cited: (src, dst), either way, applies to the best
    `pool` of a left row, before its `per_left` are taken. missing: (side, name) of the rows that stay and have no row.
    """
    kept = materialize(rows.filter(~F.coalesce(dropped, F.lit(False))), "dictionary-rows")
    found = dictionary(kept, left, right, pool, score)
    if cited is not None:
        both = cited.select(F.col("src").alias("name"), F.col("dst").alias("other"))
        both = both.union(both.select("other", "name")).distinct()
        found = found.join(both, ["name", "other"], "left_anti")
    order = Window.partitionBy("name").orderBy(F.round("total", 9).desc(), F.col("common").desc(), "vars", "other")
    found = materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_left), "dictionary")
    side = lambda where, label, column: kept.filter(where).select(F.lit(label).alias("side"), "name").join(found.select(F.col(column).alias("name")), "name", "left_anti").select("side", "name")
    return found, side(left, "left", "name").union(side(right, "right", "other"))


def coherence(found: DataFrame, rights: DataFrame) -> DataFrame:
    """Counts of a dictionary: rows, lefts, rights, distinct right statements, rows that share their right.

    rights: (other, root).
    """
    share = found.groupBy("other").agg(F.count("*").alias("n"))
    both = found.join(share, "other").join(rights, "other")
    return both.agg(
        F.count("*").alias("rows"), F.countDistinct("name").alias("lefts"), F.countDistinct("other").alias("rights"), F.countDistinct("root").alias("statements"),
        F.countDistinct(F.when(F.col("n") > 1, F.col("other"))).alias("contested"), F.count_if(F.col("n") > 1).alias("in_collision"), F.max("n").alias("worst"),
    )


def shuffled(found: DataFrame) -> DataFrame:
    """The rows of a dictionary paired anew by a fixed stride, as a control: (name, other) by place of (name)."""
    placed = numbered(found.select("name", "other"), "name", "other")
    m = placed.count()
    moved = placed.select("name", F.pmod(F.col("i") * 7919 + 13, F.lit(max(m, 1))).alias("j"))
    return moved.join(placed.select(F.col("i").alias("j"), "other"), "j").select("name", "other")


def frontier(rows: DataFrame, cross: DataFrame, least: int = 200, top: int = 20) -> DataFrame:
    """Pairs of theories by how many shapes they share beyond chance, damped by the citations between them.

    rows: (theory, shape); cross: (left, right, n). Pairs that share no shape have nothing beyond chance and are left out,
    so that theories meet by their shapes alone.
    """
    shapes = rows.select("theory", "shape").distinct()
    sizes = shapes.groupBy("theory").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    every = shapes.agg(F.countDistinct("shape").alias("m"))
    s = shapes.join(sizes.select("theory"), "theory")
    both = s.select("shape", F.col("theory").alias("left")).join(s.select("shape", F.col("theory").alias("right")), "shape").filter("left < right")
    shared = both.groupBy("left", "right").agg(F.count("*").alias("shared"))
    for side, n in (("left", "na"), ("right", "nb")):
        shared = shared.join(sizes.select(F.col("theory").alias(side), F.col("n").alias(n)), side)
    pairs = shared.join(F.broadcast(every))  # one row
    excess = F.col("shared") / F.least("na", "nb") - F.greatest("na", "nb") / F.col("m")
    pairs = pairs.withColumn("excess", excess).join(cross.withColumnRenamed("n", "cross"), ["left", "right"], "left")
    pairs = pairs.withColumn("cross", F.coalesce("cross", F.lit(0)).cast("long")).withColumn("score", F.col("excess") / (1 + F.sqrt("cross")))
    return pairs.orderBy(F.round("score", 9).desc(), "left", "right").limit(top)


def rule_keys(parsed: DataFrame) -> DataFrame:
    """(name, shallow, deep) of conclusions: head with arity, and with the arguments' heads; null for variable heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms.rule_key(terms.parse("x-stmt-v1;" + c)) for c in b.column(1).to_pylist()]
            shallow = [f and f"{f[0]}/{f[1]}" for f in found]
            deep = [f and f"{f[0]}/{f[1]}({','.join(f[2])})" for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shallow, _S), pa.array(deep, _S)], names=["name", "shallow", "deep"])

    return parsed.select("name", "concludes").mapInArrow(run, "name string, shallow string, deep string")


def rule_stats(parsed: DataFrame) -> DataFrame:
    """How many rule keys there are, how large the largest bucket is, of either depth, and rows with a variable head."""
    keys = rule_keys(parsed)
    out = keys.agg(F.count_if(F.col("shallow").isNull()).alias("flex"))
    for depth in ("shallow", "deep"):
        sizes = keys.filter(F.col(depth).isNotNull()).groupBy(depth).agg(F.count("*").alias("n"))
        out = out.join(sizes.agg(F.count("*").alias(f"{depth}_keys"), F.coalesce(F.max("n"), F.lit(0)).alias(f"{depth}_largest")))
    return out


def find(rows: DataFrame, pattern: str, term: str = "root") -> DataFrame:
    """(name, fillings): rows whose term a pattern matches, with what its variables stand for, in order; holes match anything."""
    wanted = terms.parse("x-stmt-v1;" + pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(n, terms.matches(wanted, terms.parse("x-stmt-v1;" + t))) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            out = [(n, [terms.render(m[k]) for k in sorted(m)]) for n, m in out if m is not None]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], _S), pa.array([m for _, m in out], pa.list_(_S))], names=["name", "fillings"])

    return rows.select("name", term).mapInArrow(run, "name string, fillings array<string>")


def image(left: str, right: str, subject: str) -> str | None:
    """The subject moved as left is moved to right; None where it is no instance or a variable hides a bound one."""
    x, y, s = (terms.parse("x-stmt-v1;" + t) for t in (left, right, subject))
    skeleton, pairs, scoped = terms.generalise(x, y)
    bound = None if scoped else terms.matches(skeleton, s)
    if bound is None:
        return None
    return terms.render(terms.substitute(skeleton, {i: pairs[i][1] if v == pairs[i][0] else v for i, v in bound.items()}))


def transport_all(pairs: DataFrame, subjects: DataFrame, rows: DataFrame, *keys: str, term: str = "erased") -> DataFrame:
    """transport() of each pair (left, right, keys) and all subjects (subject, keys, term) that have its keys.

    Distinct terms meet, and only those that have an image are joined to their declarations, in the last step: the result may
    grow with the square of a statement's copies, but nothing of that size is kept or moved.
    """
    held = pairs
    for side in ("left", "right"):
        held = held.join(rows.select(F.col("name").alias(side), F.col(term).alias(f"{side}_t")).hint("merge"), side)
    held = materialize(held.select("left", "right", *keys, "left_t", "right_t"), "pairs")
    asked = materialize(subjects.select("subject", *keys, F.col(term).alias("subject_t")).join(held.select(*keys).distinct(), list(keys), "left_semi"), "subjects")
    every = held.select(*keys, "left_t", "right_t").distinct().join(asked.select(*keys, "subject_t").distinct(), list(keys))
    images = materialize(_images(spread(every.select("left_t", "right_t", "subject_t").distinct())).filter("image is not null"), "images")
    first = rows.groupBy(F.col(term).alias("image")).agg(F.min_by("name", "seq").alias("exists"))
    known = images.join(first.hint("merge"), "image", "left")
    return held.join(known.hint("merge"), ["left_t", "right_t"]).join(asked.hint("merge"), [*keys, "subject_t"]).select("left", "right", "subject", "image", "exists")


def _images(triples: DataFrame) -> DataFrame:
    """(left_t, right_t, subject_t, image) of three terms each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = [image(*ts) for ts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(moved, _S)], names=["left_t", "right_t", "subject_t", "image"])

    return triples.mapInArrow(run, "left_t string, right_t string, subject_t string, image string")


def transport(wanted: DataFrame, rows: DataFrame, term: str = "erased") -> DataFrame:
    """wanted (left, right, subject) with the subject's image and the first declaration that states it.

    rows: seq, name, term.
    """
    out = wanted
    for side in ("left", "right", "subject"):
        out = out.join(rows.select(F.col("name").alias(side), F.col(term).alias(f"{side}_t")), side)

    keys = ["left_t", "right_t", "subject_t"]
    images = _images(out.select(*keys).distinct())
    first = rows.groupBy(F.col(term).alias("image")).agg(F.min_by("name", "seq").alias("exists"))
    return out.join(images, keys).filter("image is not null").join(first, "image", "left").select("left", "right", "subject", "image", "exists")


def census(parsed: DataFrame) -> DataFrame:
    """Sizes of statements by kind."""
    p = lambda q: F.percentile("size", q)
    return parsed.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), p(0.5).alias("median"), p(0.9).alias("p90"), F.max("size").alias("most"), F.avg("concrete").alias("concrete"), F.countDistinct("root").alias("distinct_roots"))
