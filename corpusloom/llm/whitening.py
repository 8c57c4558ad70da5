"""Whitening of embeddings by a covariance over different vectors, weighted by how often they occur or by one.

Vectors become integers (``floor(scale * c) + offset``), so that equal ones are equal exactly.  Rows are grouped by their
integer vector in salted parts (combined within tasks, so copies cost a row a task); a fit goes over the groups, each with
the weight one or its count.  Weights and sums by dimension are exact.  The covariance is a sum of centred matrix products,
one a task, added in two levels; only its d x d numbers reach the driver, where its eigenvectors are taken (their largest
entry is positive, so they are the same in every run).  Each different vector is whitened once and joined back to its rows.

An entry is centred as (n x - S) / n with an exact numerator: x and the mean are about a million, and subtracting two
doubles of that size would lose digits.

Defined results: rows whose vector is null, empty, of another length than the commonest (of equally common ones the
shorter), or that holds null, non-finite or too large entries (2**54 and more in size) are dropped; components whose
eigenvalue is under 1e-10 of the largest have no whitened values and are left out, so n equal vectors give no rows;
repeated ids and null ids are rows each; ``deviation`` is exact up to 38 digits, null beyond; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import saved, summed, table

_SAFE = 1 << 62


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, x array<long>, key (digest of x) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 54)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), good.alias("good")).where("v is not null and good and size(v) > 0").drop("good")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("x", lambda c: c.cast("string")), ","), 256)))


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def exact_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight and weighted sums by dimension, as Python integers."""
    if int(np.abs(x).max()) * int(w.sum()) < _SAFE:
        total = (x * w[:, None]).sum(axis=0)
    else:
        total = (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
    return np.array([int(w.sum()), *map(int, total)], dtype=object)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they suffice, else in Python integers."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    y = x - whole
    if n * (int(np.abs(y).max(initial=0)) + 1) < _SAFE:
        return n * y - rest.astype(np.int64)
    return n * y.astype(object) - rest


def squares(num: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if num.dtype != object and num.shape[1] * int(np.abs(num).max(initial=0)) ** 2 < _SAFE:
        return (num * num).sum(axis=1).tolist()
    return [sum(int(a) * int(a) for a in row) for row in num]


def _gathered(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], unpack: Callable, pack: Callable):
    """What ``each`` makes of the batches, added up over all tasks; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = each(batch) if total is None else total + each(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], names=["total"])

    got = summed(rows.mapInArrow(run, "total binary"), unpack, pack).collect()
    return unpack(got[0]["total"]) if got else None


_INTS = (lambda b: np.array(json.loads(bytes(b)), dtype=object), lambda v: json.dumps(v.tolist()).encode())
_FLOATS = (lambda b: np.frombuffer(bytes(b)).copy(), lambda v: np.ascontiguousarray(v, np.float64).tobytes())


def components_of(groups: DataFrame, most: int, least: float = 1e-10) -> tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray] | None:
    """n, S, eigenvalues, unit eigenvectors (columns), shares of the trace of ``groups(x, weight)``; None without rows."""
    sums = _gathered(groups.select("x", "weight"), lambda b: exact_sums(matrix(b.column(0)), b.column(1).to_numpy()), *_INTS)
    if sums is None:
        return None
    n, sums = int(sums[0]), [int(s) for s in sums[1:]]

    def product(batch: pa.RecordBatch) -> np.ndarray:
        centred = (numerators(matrix(batch.column(0)), n, sums) / n).astype(np.float64)
        return ((centred * batch.column(1).to_numpy()[:, None]).T @ centred).ravel()

    v = _gathered(groups.select("x", "weight"), product, *_FLOATS).reshape(len(sums), len(sums)) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = int(min(most, np.count_nonzero(values > least * values[0]) if values[0] > 0 else 0))
    vectors = vectors[:, :used]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(used)])
    return n, sums, values[:used], vectors, values[:used] / np.trace(v)


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 16, weights: str = "one", scale: int = 64, offset: int = 1_000_000, salts: int = 64) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component.

    ``weights`` is "one" (each different vector counts once) or "count" (as often as it occurs); n is their sum.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights: one or count")
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, column, scale, offset).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    parts = saved(rows.groupBy("key", "x", "salt").agg(F.count(F.lit(1)).alias("c")), "vector-parts")
    weight = F.sum("c") if weights == "count" else F.lit(1).cast("long")
    groups = saved(parts.groupBy("key", "x").agg(weight.alias("weight")), "vectors")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = components_of(groups, most)
    if fit is None or not len(fit[2]):
        return spark.createDataFrame([], schema)
    n, sums, values, turn, shares = fit
    turn = turn / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = numerators(matrix(batch.column(1)), n, sums)
            w = (num / n).astype(np.float64) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            deviation = pa.array([Decimal(s) if s < 10**38 else None for s in squares(num)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), deviation, lists], names=["key", "weight", "deviation", "w"])

    white = saved(groups.select("key", "x", "weight").mapInArrow(project, "key binary, weight long, deviation decimal(38,0), w array<double>"), "whitened")
    floats = white.select("w", "weight")
    mean = _gathered(floats, lambda b: b.column(1).to_numpy() @ matrix(b.column(0), np.float64), *_FLOATS) / n

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        d = matrix(batch.column(0), np.float64) - mean
        return ((d * batch.column(1).to_numpy()[:, None]).T @ d).ravel()

    k = len(values)
    error = float(np.abs(_gathered(floats, spread, *_FLOATS).reshape(k, k) / n - np.eye(k)).max())
    named = parts.select("key", "salt").join(white.select("key", "deviation", "w"), "key")
    out = rows.select("vec_id", "key", "salt").join(named, ["key", "salt"]).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*(F.lit(float(s)) for s in shares)), F.col("at"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the contract has it, ``deviation`` is a long here (null where it does not fit)."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
