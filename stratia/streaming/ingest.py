"""Slices that keep arriving: new JSON lines become valid rows of an append-only table, faults go to another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratia.sources import slices


def follow(spark: SparkSession, source: str, rows: str, faults: str, checkpoint: str, then: Callable[[DataFrame, int], object] | None = None) -> StreamingQuery:
    """Read files as they appear in `source` and append until what is there is done.

    A batch replayed after a failure writes to its own folder again, so nothing is there twice. seq grows with
    batches, so that of repeated names the last arrival wins in slices.last_of_each. then, if given, takes each batch's valid rows and its number, as Kept.add does.
    """
    stream = spark.readStream.schema("value string").text(source)

    def batch(df: DataFrame, number: int) -> None:
        numbered = df.filter(F.trim("value") != "").withColumn("line", F.lit(number << 40) + F.monotonically_increasing_id())
        parsed = numbered.withColumn("r", slices.parse(F.col("value"))).withColumn("reason", slices.fault()).drop("r")
        slices.read_rows(parsed.filter("reason is null")).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        if then is not None:
            kept = spark.read.parquet(f"{rows}/batch={number}")
            then(kept.select("seq", "name", "kind", "module", "stmt"), number)
        parsed.filter("reason is not null").select("value", "reason").write.mode("overwrite").parquet(f"{faults}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
