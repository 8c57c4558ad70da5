"""A durable backlog that lets in at most n rows a turn, spaces taking turns.

Every arriving row gets a number in its space's queue: one more than the space's last, but not less than the number that
was let in last, so a space that was idle does not save up turns.  The rows with the least numbers go first; a space with
any number of rows delays the others by one row a round.  Rows are written once where they arrive; the queue holds their
keys alone.  A turn reads the queue that the turn before left, so a turn that is repeated gives the same rows.

    arrived/turn=…   whole rows          queue/turn=…   space, key, number, arrived in turn
    spaces/turn=…    space, last number  admitted/turn=…  keys that were let in
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.storage import exists

#: Turns of a stream's batch: the first is the batch's own, the others let in what waits without new rows.
TURNS = 1_000_000
QUEUE = "space string, key string, number long, arrived long"


def _last(spark: SparkSession, root: str, before: int) -> int | None:
    """The latest turn that is finished before this one."""
    path = f"{root}/admitted"
    if not exists(spark, path):
        return None
    status = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))
    turns = [int(name.split("=")[1]) for s in status if (name := s.getPath().getName()).startswith("turn=") and exists(spark, f"{path}/{name}/_SUCCESS")]
    return max((t for t in turns if t < before), default=None)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def admit(rows: DataFrame | None, spark: SparkSession, root: str, turn: int, n: int, key: str = "path", space: str = "space") -> DataFrame:
    """The rows that are let in at this turn, at most ``n``; ``rows`` arrive with it (None: nobody does)."""
    last = _last(spark, root, turn)
    before = lambda name, schema: _read(spark, f"{root}/{name}/turn={last}", schema)
    queue, spaces = before("queue", QUEUE), before("spaces", "space string, last long")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{root}/arrived/turn={turn}")
        came = spark.read.parquet(f"{root}/arrived/turn={turn}").select(F.coalesce(F.col(space).cast("string"), F.lit("")).alias("space"), F.col(key).cast("string").alias("key"))
        now = before("admitted", QUEUE).agg(F.coalesce(F.max("number"), F.lit(0)).alias("now"))  # one row
        start = came.select("space").distinct().join(spaces, "space", "left").crossJoin(F.broadcast(now)).select("space", F.greatest(F.coalesce("last", F.lit(0)), F.col("now")).alias("start"))
        place = F.row_number().over(Window.partitionBy("space").orderBy("key")).cast("long")
        new = came.withColumn("place", place).join(start, "space").select("space", "key", (F.col("start") + F.col("place")).alias("number"), F.lit(turn).cast("long").alias("arrived"))
        queue = queue.unionByName(new)
        spaces = spaces.unionByName(new.groupBy("space").agg(F.max("number").alias("last"))).groupBy("space").agg(F.max("last").alias("last"))
    # n rows are a parameter: the sort keeps as many in a task
    queue.orderBy("number", "arrived", "key", "space").limit(n).write.mode("overwrite").parquet(f"{root}/chosen/turn={turn}")
    chosen = spark.read.schema(QUEUE).parquet(f"{root}/chosen/turn={turn}")
    queue.join(chosen.select("space", "key", "arrived"), ["space", "key", "arrived"], "left_anti").write.mode("overwrite").parquet(f"{root}/queue/turn={turn}")
    spaces.write.mode("overwrite").parquet(f"{root}/spaces/turn={turn}")
    chosen.write.mode("overwrite").parquet(f"{root}/admitted/turn={turn}")  # last: the turn is finished
    return admitted_rows(spark, root, turn, key, space)


def admitted_rows(spark: SparkSession, root: str, turn: int, key: str = "path", space: str = "space") -> DataFrame:
    """Whole rows of a finished turn, read from the folders where they arrived."""
    chosen = spark.read.schema(QUEUE).parquet(f"{root}/admitted/turn={turn}")
    turns = [r[0] for r in chosen.select("arrived").distinct().collect()]  # n at most
    if not turns:
        folder = f"{root}/arrived"
        return spark.read.option("basePath", folder).parquet(folder).drop("turn").limit(0)
    rows = spark.read.option("basePath", f"{root}/arrived").parquet(*(f"{root}/arrived/turn={t}" for t in turns))
    match = [F.col(key).cast("string") == F.col("_key"), F.coalesce(F.col(space).cast("string"), F.lit("")) == F.col("_space"), F.col("turn") == F.col("_turn")]
    picked = chosen.select(F.col("key").alias("_key"), F.col("space").alias("_space"), F.col("arrived").alias("_turn"))
    return rows.join(F.broadcast(picked), match, "left_semi").drop("turn")


def admitted_stream(stream: DataFrame, root: str, n: int, take: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path", space: str = "space") -> StreamingQuery:
    """Runs ``take(rows, turn)`` on what each batch lets in."""

    def batch(rows: DataFrame, number: int) -> None:
        turn = number * TURNS
        take(admit(rows, rows.sparkSession, root, turn, n, key, space), turn)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, root: str, n: int, take: Callable[[DataFrame, int], None], key: str = "path", space: str = "space") -> int:
    """Turns without new rows, until nobody waits: how many there were."""
    turns = 0
    while True:
        last = _last(spark, root, 1 << 62)
        if last is None or not _read(spark, f"{root}/queue/turn={last}", QUEUE).limit(1).count():
            return turns
        take(admit(None, spark, root, last + 1, n, key, space), last + 1)
        turns += 1
