"""Positions of rows in a global order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.sizing import materialise


def positions(df: DataFrame, column: str, nulls_last: bool = False) -> DataFrame:
    """Adds ``position``, 0 for the first row in ascending order of a column with distinct values.

    Rows are dealt out by ranges and counted in each; only the counts, one for
    each range, are summed in order. NULL sorts first unless ``nulls_last``.
    """
    order = F.col(column).asc_nulls_last() if nulls_last else F.col(column).asc_nulls_first()
    dealt = materialise(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    ranked = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range")
    return ranked.withColumn("position", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")
