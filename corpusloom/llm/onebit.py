"""Nearest neighbours by randomly rotated one-bit codes with correction scalars and error bounds.

The index is a table, fitted on a bounded sample (``sample`` rows give the centre) and written once for all rows: a
vector, seen from the centre, is rotated by a random orthogonal matrix and kept as one bit per dimension (packed), its
length, and the inner product of its direction with its code's direction, beside the vector itself.  A rotated query is
rounded to ``planes`` bits a dimension; its product with a code is a weighted sum of population counts of the packed bits
under the query's bit planes.  With the correction scalars this estimates the inner product without bias; the error is
below ``eps`` standard deviations with the probability that ``eps`` names (3.0: about 0.13 % of the pairs lie above their
upper bound, and only those among the nearest could be missed).

Queries are read in groups of about ``group_rows`` (the bound of what is broadcast at a time).  Each task passes over its
part of the index where it lies, ``block_rows`` at a time, and keeps the k best of each query so far: the 4 k best estimates of its first rows are
scored, and then only vectors whose upper bound reaches the k-th score so far are reranked, on the original vectors in
double precision.  Only k rows for each query and task are shuffled; neither codes nor vectors are.

Defined results: vectors that are null, empty, zero, of another length than the table's commonest, or that hold null or
non-finite components take no part; ties go to the smaller id; with fewer than k candidates all are returned; rows that
share a query's id are no candidates of it, and of several query rows with one id the least vector is searched; rows that
repeat another id are candidates each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import saved, table


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector takes part, as ``vec_id, v array<double>``."""
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), good.alias("good")).where("vec_id is not null and v is not null and good").drop("good")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def rotation(n: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of rows: packed signs of the rotated residual (64-bit words), its length, and the correction scalar."""
    residual = (x - centre) @ turn
    bits = np.zeros((len(x), -(-x.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(residual > 0, axis=1)
    bits[:, : packed.shape[1]] = packed
    length = np.linalg.norm(residual, axis=1)
    return bits.view(np.uint64), length, np.abs(residual).sum(axis=1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)


class Queries:
    """Rotated queries as bit planes, and what turns counts into estimates."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, planes: int = 5, eps: float = 3.0):
        turned = q @ turn
        low = turned.min(axis=1, keepdims=True)
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**planes - 1), 1e-300)
        units = np.rint((turned - low) / self.step).astype(np.uint8)
        self.planes = np.zeros((planes, len(q), -(-q.shape[1] // 64) * 8), np.uint8)
        for j in range(planes):
            packed = np.packbits((units >> j) & 1, axis=1)
            self.planes[j, :, : packed.shape[1]] = packed
        self.planes = self.planes.view(np.uint64)
        self.ids, self.q, self.low, self.eps, self.size = ids, q, low, eps, q.shape[1]
        self.total = (low + self.step * units).sum(axis=1, keepdims=True)
        self.base, self.norm = q @ centre, np.linalg.norm(q, axis=1, keepdims=True)

    def estimates(self, part: slice, bits: np.ndarray, length: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of the queries in ``part`` with coded rows (queries, rows), and the half width of
        their error bounds: the code's share and that of rounding the query."""
        ones = np.bitwise_count(bits).sum(axis=1)
        weighted = 0.0
        for j in range(len(self.planes)):
            count = 0
            for w in range(bits.shape[1]):
                count = count + np.bitwise_count(bits[None, :, w] & self.planes[j, part, None, w]).astype(np.uint16)
            weighted = weighted + np.float32(1 << j) * count
        # <signs, q> = 2 <bits, q> - <1, q>
        signs = 2 * (self.low[part] * ones + self.step[part] * weighted) - self.total[part]
        scale = 1 / np.where(agree > 0, agree, 1)
        wide = self.norm[part] * (scale * length * np.sqrt(np.maximum(1 - agree**2, 0)) / np.sqrt(max(self.size - 1, 1)))
        rounding = self.step[part] / np.sqrt(12) * (scale * length)
        return self.base[part][:, None] + signs * (length * scale / np.sqrt(self.size)), self.eps * np.sqrt(wide**2 + rounding**2) + 1e-9


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components, so that equal vectors have equal scores."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


class Search:
    """The k best of each query over the rows that a task has read so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(queries.ids)

    def read(self, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, agree: np.ndarray) -> None:
        k, asked = self.k, self.queries
        for at in range(0, len(asked.ids), 64):
            est, wide = asked.estimates(slice(at, at + 64), bits, length, agree)
            upper = est + wide
            for i in range(len(est)):
                score, found = self.best[at + i]
                me, other = asked.q[at + i], ids != asked.ids[at + i]
                if len(score) < k and len(ids) > 4 * k:  # the k-th of the best estimates' scores is a first bar
                    first = np.argpartition(-np.where(other, est[i], -np.inf), 4 * k - 1)[: 4 * k]
                    first = first[other[first]]
                    rough = np.sort(x[first] @ me)
                    bar = rough[-k] if len(rough) >= k else -np.inf
                    near = (upper[i] >= bar) & other
                    near[first] = True
                    rows = np.flatnonzero(near)
                else:
                    bar = score[-1] if len(score) >= k else -np.inf
                    rows = np.flatnonzero((upper[i] >= bar) & other)
                if len(rows) > k:  # rounding differs with the place of a row in a product: what is close to the bar stays
                    rough = x[rows] @ me
                    least = max(bar, float(np.partition(rough, -k)[-k]))
                    rows = rows[rough >= least - 1e-9 * max(1.0, float(np.abs(rough).max()))]
                if len(rows):
                    score, found = np.concatenate([score, exact(me, x[rows])]), np.concatenate([found, ids[rows]])
                    keep = _best(score, found, k)
                    self.best[at + i] = (score[keep], found[keep])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(vectors: DataFrame, sample: int = 4_096) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(vec_id, v, bits, length, agree of all rows, written to the shared folder; centre; rotation), None of no rows."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    if not some:
        return None
    centre, turn = np.mean([r["v"] for r in some], axis=0), rotation(len(some[0]["v"]))
    known = vectors.sparkSession.sparkContext.broadcast((centre, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, agree = encode(_vectors(batch.column(1)), *known.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(agree)], names=["vec_id", "v", "bits", "length", "agree"])

    return saved(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, bits binary, length double, agree double"), "codes"), centre, turn


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 8_192, group_rows: int = 65_536, sample: int = 4_096, eps: float = 3.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each of ``queries`` (both ``vec_id, v``)."""
    spark, made = vectors.sparkSession, index(vectors, sample)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = -(-queries.count() // group_rows)
    if made is None or not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes, centre, turn = made
    found = None
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)) == g).collect()
        if rows:
            part = _search(codes, Queries(np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows]), centre, turn, eps=eps), k, block_rows)
            part = part if groups == 1 else saved(part, "nearest")
            found = part if found is None else found.union(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(codes: DataFrame, queries: Queries, k: int, block_rows: int) -> DataFrame:
    asked = codes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(asked.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ids, bits, length, agree = part.column(0).to_numpy(), b"".join(part.column(2).to_pylist()), part.column(3).to_numpy(), part.column(4).to_numpy()
                search.read(ids, _vectors(part.column(1)), np.frombuffer(bits, np.uint64).reshape(len(ids), -1), length, agree)
        for q, (score, found) in zip(asked.value.ids, search.best):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return codes.mapInArrow(run, "query_id long, vec_id long, score double")


def op4_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
