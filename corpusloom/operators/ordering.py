"""Positions and running sums in an order, where a key may hold any share of the rows.

Rows are dealt out by ranges of (key, order), so a large key takes many tasks; each range sums its own rows, and the sums
of the ranges before it are added.  Nothing is collected, and no key is one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import saved


def running_sum(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of its key up to this one, in ``order`` (a total one)."""
    dealt = rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = saved(dealt, "ranges")
    here = Window.partitionBy(*keys, "_range")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    match = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = dealt.withColumn("_local", F.sum("_value").over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(sums, match).select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))


def positions(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: their place in ``order`` (a total one) among the rows of their key, from 1."""
    return running_sum(rows, keys, order, F.lit(1).cast("long"), name)
