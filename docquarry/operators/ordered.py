"""Running sums over ordered rows of which one key may hold a large part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Values of the leading order column that are summed in one window.
WIDTH = 1024


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the running sum of an integer in the column `name`, within keys, by order; nulls of value count as 0.

    The first order column is an integer. Rows are summed in ranges of it, then the ranges' totals are summed, one small row
    for each, and added: no task gets more of a key than a range. Rows with equal order values count together.
    """
    held = rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))).withColumn("_range", F.floor(F.col(order[0]) / F.lit(width)))
    own = held.withColumn(name, F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    totals = held.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_range").eqNullSafe(F.col("_r"))]
    joined = own.join(offsets, same, "left")
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_range", "_r", "_before", *(f"_{k}" for k in keys))
