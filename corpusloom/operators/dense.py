"""Exact nearest vectors by blocked matrix products: a block of vectors meets a block of questions in one product, and only
the first n of each question and block go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions are broadcast up to so many bytes; beyond that they are sent to ``SALTS`` parts of each key.
BROADCAST_BYTES, SALTS = 64 << 20, 32


def _blocks(rows: DataFrame, keys: list[str], name: str, vector: str, size: int) -> DataFrame:
    """keys, block, items ARRAY<STRUCT<name, vector>> of about ``size`` rows, dealt by hash."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(counts, keys)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(name), F.ceil(F.col("_n") / size)).cast("int"))
    return dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct(F.col(name), F.col(vector).alias("v"))).alias("items"))


def _best(scores: np.ndarray, names: np.ndarray, n: int, low: float) -> np.ndarray:
    """Positions of the first n by score, then name, above ``low``."""
    at = np.flatnonzero(scores > low)
    if len(at) > n:
        nth = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= nth]
    return at[np.lexsort((names[at], -scores[at]))][:n]


def nearest(qvecs: DataFrame, vectors: DataFrame, min_cosine: float, n: int, digits: int | None = None, rows: int = 2048, questions: int = 512, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """qid, path, cos: of ``qvecs(qid, acl_key, qv)`` the n best rows above ``min_cosine`` in every block of ``vectors(acl_key,
    path, embedding)`` with their key and length; the first n of these are the first n of all.

    Vectors with null or non-finite components have no product.
    """
    usable = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = qvecs.where(usable("qv")).select("qid", "acl_key", F.size("qv").alias("dim"), F.col("qv").cast("array<double>").alias("qv"))
    keys = asked.select("acl_key", "dim").distinct()
    held = vectors.where(usable("embedding")).select("acl_key", F.size("embedding").alias("dim"), "path", F.col("embedding").cast("array<double>").alias("embedding")).join(keys, ["acl_key", "dim"], "left_semi")
    left, right = _blocks(asked, ["acl_key", "dim"], "qid", "qv", questions), _blocks(held, ["acl_key", "dim"], "path", "embedding", rows)
    left = left.select("acl_key", "dim", F.col("items").alias("asked"))
    size = asked.agg(F.coalesce(F.sum(8 * F.col("dim") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= broadcast_bytes:
        pairs = right.join(F.broadcast(left), ["acl_key", "dim"])
    else:
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = right.withColumn("salt", F.pmod("block", F.lit(SALTS))).join(left, ["acl_key", "dim", "salt"])

    def unit(items: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        names, v = items.flatten()
        return names, v.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)

    kinds = {c: qvecs.schema["qid"].dataType.simpleString() if c == "qid" else vectors.schema["path"].dataType.simpleString() for c in ("qid", "path")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (qids, q), (paths, v) = unit(batch.column(0)[i].values), unit(batch.column(1)[i].values)
                names = np.array(paths.to_pylist())
                scores = q @ v.T
                if digits is not None:
                    scores = np.floor(scores * 10.0**digits + 0.5) / 10.0**digits
                picked = [_best(s, names, n, min_cosine) for s in scores]
                at = np.concatenate(picked)
                of = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), paths.take(pa.array(at)), pa.array(scores[of, at])], names=["qid", "path", "cos"])

    return pairs.select("asked", "items").mapInArrow(run, f"qid {kinds['qid']}, path {kinds['path']}, cos double")
