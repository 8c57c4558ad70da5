"""What is remembered for ever: tables partitioned by a prefix of a hash, with a folder for each batch in it.

A batch reads the prefixes that its own keys have and no others (partition pruning), without its own folder, so a batch that
is repeated decides as it did before; it replaces the folders that it writes (dynamic partition overwrite).  A prefix of
``digits`` hexadecimal digits makes 16 ** digits partitions, the bound of what the driver holds of a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import exists


def prefix(key: Column | str, digits: int = 2) -> Column:
    """The first digits of a hexadecimal hash."""
    return F.substring(F.col(key) if isinstance(key, str) else key, 1, digits)


def remembered(spark: SparkSession, path: str, schema: str, keys: DataFrame, batch: int) -> DataFrame:
    """Rows of other batches in the partitions of ``keys(prefix)``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wanted = sorted(r[0] for r in keys.select("prefix").where("prefix is not null").distinct().collect())
    rows = spark.read.schema(f"{schema}, prefix string, batch long").option("basePath", path).parquet(path)
    return rows.where(F.col("prefix").isin(wanted) & (F.col("batch") != batch)).drop("prefix", "batch")


def remember(rows: DataFrame, path: str, batch: int) -> None:
    """Writes ``rows(…, prefix)`` as what the batch adds."""
    if rows.limit(1).count():  # an empty write would be no table
        rows.withColumn("batch", F.lit(batch).cast("long")).repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(path)


def first_seen(rows: DataFrame, seen: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``duplicate``: its keys are in ``seen``, or in an earlier row by ``order``.

    A key's earlier row is its least, found by an aggregate, so rows of one key need not meet.
    """
    least = rows.groupBy(*keys).agg(F.min(order).alias("_least"))
    old = seen.select(*keys).distinct().withColumn("_old", F.lit(True))
    named = least.join(old, keys, "left")
    return rows.join(named, keys).withColumn("duplicate", F.coalesce("_old", F.lit(False)) | (F.col(order) != F.col("_least"))).drop("_old", "_least")
