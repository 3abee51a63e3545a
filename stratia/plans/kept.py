"""A kept index over two deliveries of the corpus, of which the second mends a third of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import statements as st
from stratia.operators.kept import Kept
from stratia.plans import statements as plans
from stratia.session import scratch
from stratia.sources import derived


def _index(spark: SparkSession, d: str) -> Kept:
    index, rows = Kept(spark, scratch(spark, "index")), derived.declarations(spark, d)
    late = F.col("seq") % 3 == 0
    index.add(rows.withColumn("stmt", F.when(late, F.lit(derived.PREFIX + "a(a(c(3:Old,0),n1),n2)")).otherwise(F.col("stmt"))), 0)
    index.add(rows.filter(late), 1)
    return index


def kept_postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings().select("key", "n", "size", F.round("idf", 6).alias("idf"))


def kept_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal statements from the kept rows, of which three columns are read."""
    return st.classes(_index(spark, d).statements().select("seq", "name", F.col("root").alias("erased")))


QUERIES = {f.__name__: f for f in (kept_postings, kept_classes)}
SQL = {"kept_postings": plans.SQL["postings_idf"], "kept_classes": plans.SQL["equiv_classes_exact"]}
