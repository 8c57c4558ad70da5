"""Vector columns: normalisation, cosine, a deterministic embedder; and hashes of configurations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def vec_normalize(a: Column | str) -> Column:
    """Unit length; null for zero and non-finite vectors."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(col(a), lambda x: (x.cast("double") / n).cast("float")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_bigram_embed(texts: pd.Series) -> pd.Series:
    """256 hashed character bigrams, unit length; for tests and offline use."""
    from hashlib import blake2b

    def one(text):
        v = np.zeros(256, np.float32)
        t = " ".join((text or "").lower().split()) or " "
        for a, b in zip(t, t[1:] or " "):
            v[int.from_bytes(blake2b((a + b).encode(), digest_size=4).digest(), "big") % 256] += 1
        return (v / np.linalg.norm(v)).tolist()

    return texts.map(one)


def config_hash(columns: list[str]) -> Column:
    """16 hex digits over the columns in the order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def cache_key(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*(col(p).cast("string").alias(f"k{i}") for i, p in enumerate(parts)))), 256)


DEFAULTS = {"rrf_k": 60, "w_bm25": 1.0, "w_dense": 1.0, "min_cosine": 0.0, "bm25_k1": 1.5, "bm25_b": 0.75}
IRRELEVANT = {"bm25": ("rrf_k", "w_bm25", "w_dense", "min_cosine"), "dense": ("rrf_k", "w_bm25", "w_dense", "bm25_k1", "bm25_b")}


def canonical_config(configs: DataFrame) -> DataFrame:
    """Knobs without influence in a row's mode are reset; equal rows become one; ``hash`` names a row."""
    out = configs
    for mode, knobs in IRRELEVANT.items():
        for k in knobs:
            if k in configs.columns:
                out = out.withColumn(k, F.when(F.col("retrieval_mode") == mode, F.lit(DEFAULTS[k])).otherwise(F.col(k)))
    knobs = [c for c in out.columns if c != "hash"]
    return out.withColumn("hash", config_hash(knobs)).dropDuplicates(["hash"])
