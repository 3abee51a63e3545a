"""The queries of this package and, where SQL can express one, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratia.llm import bpe, centroids, flac, importance, langid, lattice, mixing, neighbours, pii, sharding, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_sharding": sharding.op2_sharding,
        "op3_pii": pii.op3_pii,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_warc": warc.op5_warc,
        "op6_simhash": simhash.op6_simhash,
        "op7_lattice": lattice.op7_lattice,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_nearest": neighbours.op9_nearest,
        "op10_flac": flac.op10_flac,
        "op11_language": langid.op11_language,
        "op12_importance": importance.op12_importance,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.op1_sql(), "op2_sharding": sharding.op2_sql(), "op5_warc": warc.op5_sql(), "op9_nearest": neighbours.op9_sql(), "op12_importance": importance.op12_sql(), "op13_centroids": centroids.op13_sql()}
