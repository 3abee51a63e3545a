"""Numbers for the rows of a whole table in a given order, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratia.session import materialize, shuffle_partitions


def numbered(df: DataFrame, *order: Column | str, column: str = "i") -> DataFrame:
    """df with the place of each row from 0, by ranges of the order; ties fall in any order.

    Rows are dealt out by range and sorted inside each part; a part's first number is the sum of the parts before it,
    which is a running sum over one row a part.
    """
    parts = shuffle_partitions(df.sparkSession)
    held = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("c")).select("_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_first"))
    return held.withColumn("_part", part).withColumn("_inside", inside).join(firsts, "_part").withColumn(column, F.col("_first") + F.col("_inside")).drop("_part", "_first", "_inside", "_row")


def running(df: DataFrame, value: str, *order: Column | str, column: str = "before") -> DataFrame:
    """df with the sum of a column over the rows before each one in a given order, without a window that holds all rows.

    Rows are dealt out by range; inside a part the sum runs over the part alone, and a part starts with the sums of those
    before it, which is a running sum over one row a part. Rows of equal order stand in any order.
    """
    parts = shuffle_partitions(df.sparkSession)
    held = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "running")
    held = held.withColumn("_part", F.shiftright("_row", 33))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.groupBy("_part").agg(F.sum(value).alias("c")).select("_part", F.coalesce(F.sum("c").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_first"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("_part").orderBy("_row"))), F.lit(0))
    return held.withColumn("_inside", inside).join(firsts, "_part").withColumn(column, F.col("_first") + F.col("_inside")).drop("_part", "_first", "_inside", "_row")
