"""A corpus pipeline of five stages, each a function from documents to documents, the last to encoded documents.

    toxicity        documents whose noisy-or score reaches the threshold go
    near duplicates of each group of linked SimHash fingerprints the row with the smallest id stays
    surrogates      personal data gives way to keyed surrogates; n_chars follows the new text
    mixing          sources meet their target weights: a document's rows are its copies in the mix
    encoding        byte-level BPE ids, with counts and digests of both directions

A stage works on all that the one before it kept. run() writes each stage's result to the shared folder and reads it
back, so that a lost executor costs a stage's part at most. Nulls, empty texts, repeated rows and empty tables have
the results that the operators state; rows without an id come after the others in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.llm import bpe, mixing, pii, simhash, toxicity
from stratia.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(COLUMNS), toxicity.trained(spark, docs, sf_dir))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs).select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The stages' models, fingerprints and tokenizer can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
