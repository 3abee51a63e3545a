"""What tells a derived declaration from one that was written: fifteen columns, and a fitted baseline next to the fixed rank.

Defined cases: statements that are null or no terms have no binders; what is used but not declared is of no known kind;
a declaration that uses nothing in its proof has shares of zero; folds without both labels have no AUC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratia.functions import terms
from stratia.operators.hypotheses import auc
from stratia.session import checkpoint, materialize

COLUMNS = [
    "proof_frac_theorem", "proof_frac_recursor", "proof_frac_ctor", "proof_frac_def", "proof_frac_struct", "proof_over_stmt", "proof_size", "stmt_size",
    "enc_len", "n_binders", "frac_inst_binders", "frac_impl_binders", "in_degree", "foreign_proof", "is_theorem",
]
SEED, FOLDS = 5, 4


def binder_counts(decls: DataFrame) -> DataFrame:
    """(name, binders, inst, impl): binders in front of a statement, and how many are by instance or implicit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stmt in b.column(1).to_pylist():
                try:
                    t, infos = terms.parse(stmt) if stmt is not None else ("_",), []
                except terms.TermError:
                    t, infos = ("_",), []
                while t[0] == "p":
                    infos.append(t[1])
                    t = t[3]
                rows.append((len(infos), infos.count("t"), infos.count("i")))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3))], names=["name", "binders", "inst", "impl"])

    return decls.select("name", "stmt").mapInArrow(run, "name string, binders int, inst int, impl int")


def features(decls: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, ...COLUMNS) of each declaration, all doubles.

    decls: (name, kind, space, stmt), names unique; uses: (name, used, lens), each use as often as it is listed. A used
    name meets its kind and space once for each use; uses are counted by name on both sides, with partial sums.
    """
    known = decls.select(F.col("name").alias("used"), F.col("kind").alias("used_kind"), F.col("space").alias("used_space"))
    proof = uses.filter("lens = 'proof'").select("name", "used").join(known, "used", "left").join(decls.select("name", "space"), "name")
    kind = lambda *ks: F.count_if(F.coalesce(F.col("used_kind").isin(*ks), F.lit(False)))
    foreign = F.count_if(~F.col("space").eqNullSafe(F.coalesce("used_space", F.col("used"))))
    proofs = proof.groupBy("name").agg(F.count("*").alias("up"), kind("theorem").alias("t"), kind("recursor").alias("r"), kind("constructor").alias("c"), kind("def").alias("d"), foreign.alias("f"))
    stated = uses.filter("lens = 'statement'").groupBy("name").agg(F.count("*").alias("us"))
    cited = uses.groupBy(F.col("used").alias("name")).agg(F.count("*").alias("cited"))
    rows = decls.select("name", "kind", F.coalesce(F.octet_length("stmt"), F.lit(0)).alias("enc")).join(binder_counts(decls), "name")
    for more in (proofs, stated, cited):
        rows = rows.join(more, "name", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    over = lambda c, d: n(c) / F.greatest(n(d), F.lit(1.0))
    made: list[Column] = [over("t", "up"), over("r", "up"), over("c", "up"), over("d", "up"), (n("r") + n("c")) / F.greatest(n("up"), F.lit(1.0)), over("up", "us"), n("up"), n("us"),
                          n("enc"), n("binders"), over("inst", "binders"), over("impl", "binders"), n("cited"), over("f", "up"), F.when(F.col("kind") == "theorem", 1.0).otherwise(0.0)]
    return rows.select("name", *(m.alias(c) for m, c in zip(made, COLUMNS, strict=True)))


def fold(name: Column, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), name), F.lit(FOLDS)).cast("int")


def baseline(table: DataFrame, labels: DataFrame, columns: list[str] = COLUMNS, seed: int = SEED) -> DataFrame:
    """(name, held_out, score): a logistic regression on standardised columns, fitted on all folds but the first.

    labels: (name, label), of which rows without one take no part in the fit.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = materialize(table.join(labels.select("name", F.col("label").cast("double").alias("label")), "name", "left").withColumn("held_out", fold(F.col("name"), seed) == 0), "features")
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=100, regParam=1e-4)]
    fitted = Pipeline(stages=stages).fit(rows.filter("not held_out and label is not null"))
    return fitted.transform(rows).select("name", "held_out", vector_to_array("probability")[1].alias("score"))


def judged(scores: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(family, positives, negatives, auc) of each score (name, score) against the labels."""
    out = None
    for family, score in scores.items():
        one = score.join(labels, "name").select(F.lit(family).alias("family"), "score", (F.col("label") > 0).alias("positive"))
        out = one if out is None else out.union(one)
    return auc(checkpoint(out))
