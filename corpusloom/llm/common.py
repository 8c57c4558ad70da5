"""Shared helpers of the training-data operators: scratch tables, deterministic hashes, samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a folder of our own is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_LIVE: dict = {}


def worker_cache(name: str, key, make):
    """An object that a Python worker keeps between tasks.  There is one a worker: asking for another drops it, so the
    caches of a pipeline's stages do not add up in the workers that all stages share."""
    if _LIVE.get("key") != (name, key):
        drop_worker_cache()
        _LIVE.update(key=(name, key), value=make())
    return _LIVE["value"]


def drop_worker_cache() -> None:
    """Drop what the worker keeps and give the memory back to the system."""
    if _LIVE:
        _LIVE.clear()
        release_memory()


def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "4m") -> None:
    """At most ``rows`` rows and, unless the session says otherwise, about ``size`` bytes an Arrow batch in this session:
    whole texts are long, and both sides hold a batch at a time.  A longer row is a batch of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def release_memory() -> None:
    """Give freed memory of Python, numpy and Arrow back to the system: idle workers count as well."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """``crc32(column as text) mod modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def summed(parts: DataFrame, unpack: Callable[[bytes], Any], pack: Callable[[Any], bytes], keys: tuple[str, ...] = (), fan: int = 64) -> DataFrame:
    """One row a key of ``parts(keys, total binary)``, whose packed totals are added up.

    Tasks write a total each, so there are as many as tasks: they meet in ``fan`` parts of a key first and the sums of these
    parts after that.  Rows come sorted, and a task holds one sum at a time.
    """
    schema = parts.select(*keys, "total").schema

    def add(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = held = None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, pack(held)), kinds)], names=names)
            for batch in batches:
                kinds, names = batch.schema.types, batch.schema.names
                columns = [batch.column(i).to_pylist() for i in range(width)]
                for i, value in enumerate(batch.column(width)):
                    key = tuple(c[i] for c in columns)
                    if at is not None and key != at:
                        yield row()
                        held = None
                    held, at = unpack(value.as_py()) if held is None else held + unpack(value.as_py()), key
            if at is not None:
                yield row()

        return run

    fold = new_name(parts, "fold")
    spread = parts.select(*keys, F.pmod(F.spark_partition_id(), F.lit(fan)).alias(fold), "total")
    by = [*keys, fold]
    few = spread.repartition(*by).sortWithinPartitions(*by).mapInArrow(add(len(by)), spread.schema).drop(fold)
    last = few.repartition(*keys).sortWithinPartitions(*keys) if keys else few.repartition(1)
    return last.mapInArrow(add(len(keys)), schema)
