"""Near duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

Each bit position of a fingerprint is given a non-zero vector of ``radius + 1`` bits; for each non-zero vector v there is a
table, whose mask keeps the positions with an odd inner product with v.  ``radius`` positions are ``radius`` equations in
``radius + 1`` unknowns, so some table ignores all positions in which two fingerprints within the radius differ: they
share that table's bucket, always.  Radius 2 makes 7 tables of 36 to 37 of 64 bits.

Equal fingerprints are one node, so copies of a text weigh nothing.  A bucket of at most ``small`` fingerprints is compared
in place.  A larger one is not: its fingerprints agree on the kept bits, so the same construction is laid over the bits
that are left (64, 27 or 28, 12, ...), until buckets are small; ``small`` is at least what the last bits can tell apart, so
that ends.  Within a bucket only the edges of a spanning forest of its links are kept, which leaves the components as they
are.  Buckets are counted in salted parts before rows meet in one.

Defined results: null texts and texts without words have the fingerprint 0 and are linked like any other; texts with fewer
words than a shingle have one, their whole sequence; rows that repeat a doc_id are linked to each other by that id only if
their fingerprints are; rows without doc_id have a fingerprint, link nothing and have a null component_id; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_worker_cache, saved, small_batches, table
from corpusloom.llm.graph import components
from corpusloom.llm.minhash import slices

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: what a byte of a hash adds to the counts of its eight bits
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the 64-bit hashes of the text's shingles (repeats included)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    ones, digest = np.zeros((8, 8), np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits, signed), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of the positions are left out by one of them at least."""
    vectors = range(1, 1 << (radius + 1))
    given = {p: 1 + i % len(vectors) for i, p in enumerate(positions)}
    return [sum(1 << p for p, g in given.items() if (g & v).bit_count() % 2) for v in vectors]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(rows: DataFrame, frees: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """``bucket, at, fp`` of ``rows(bucket, at, fp)``: each row in each table over the bits that are free in its bucket;
    ``at`` numbers the sets of free bits."""
    made, after = [], []
    for free in frees:
        positions = [p for p in range(64) if free >> p & 1]
        tables = []
        for mask in covering_masks(positions, radius):
            tables.append(F.struct(F.lit(len(after)).alias("at"), F.lit(_signed(mask)).alias("mask")))
            after.append(free & ~mask)
        made.append(F.array(*tables))
    tables = made[0] if len(made) == 1 else F.get(F.array(*made), F.col("at"))
    wide = rows.select("bucket", "fp", F.explode(tables).alias("t"))
    return wide.select(F.xxhash64("bucket", "t.at", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("bucket"), "t.at", "fp"), after


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between different fingerprints."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    left, edges = set(range(len(members))), []
    while left:
        reached = [left.pop()]
        for a in reached:
            for b in [b for b in np.flatnonzero(near[a]).tolist() if b in left]:
                left.remove(b)
                reached.append(b)
                edges.append((a, b))
    return edges


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """u, v (fingerprints) of ``rows(bucket, fp)``, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            x = np.array(held, np.int64)
            e = np.array(_forest(x.view(np.uint64), radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[e[:, 0]]), pa.array(x[e[:, 1]])], names=["u", "v"])

        for batch in batches:
            for bucket, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at:
                    if len(held) > 1:
                        yield found()
                    at, held = bucket, []
                held.append(fp)
        if len(held) > 1:
            yield found()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def fingerprint_links(distinct: DataFrame, radius: int = 2, small: int = 64, salts: int = 64) -> DataFrame:
    """u, v: links between different fingerprints ``distinct(fp)`` within the radius, enough of them for the components.

    A row goes through the tables once for each level of buckets that it shares with more than ``small`` others.
    """
    rows, frees, links = distinct.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("at"), "fp"), [(1 << 64) - 1], None
    while True:
        wide, frees = _buckets(rows, frees, radius)
        wide = wide.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
        parts = wide.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("c"))
        sizes = parts.groupBy("bucket").agg(F.sum("c").alias("size")).where("size > 1")
        # a bucket's size goes to its parts, and from them to its rows, so no bucket is one task
        shared = saved(wide.join(parts.join(sizes, "bucket").select("bucket", "salt", "size"), ["bucket", "salt"]).drop("salt"), "buckets")
        here = _links(shared.where(F.col("size") <= small).select("bucket", "fp"), radius)
        links = here if links is None else links.unionByName(here)
        rows = shared.where(F.col("size") > small).select("bucket", "at", "fp")
        if rows.limit(1).count() == 0:
            return links.distinct()
        if not any(frees):
            raise RuntimeError("buckets of equal bits hold different fingerprints")


def near_fingerprints(docs: DataFrame, size: int = 3, radius: int = 2, small: int = 64, seed: int = 42, salts: int = 1024) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable): a row for each row of ``docs``."""
    if small < 1 << (radius + 1):
        raise ValueError("small: at least 2 ** (radius + 1)")
    prints = saved(fingerprints(docs, size, seed).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "fingerprints")
    parts = saved(prints.where("doc_id is not null").groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "fingerprint-parts")
    distinct = saved(parts.groupBy("fp").agg(F.min("least").alias("rep")), "fingerprint-classes")
    links = fingerprint_links(distinct.select("fp"), radius, small)
    named = links.join(distinct.toDF("u", "ru"), "u").join(distinct.toDF("v", "rv"), "v")
    labels = components(named.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    classes = distinct.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    rows = prints.where("doc_id is not null").join(parts.select("fp", "salt").join(classes, "fp"), ["fp", "salt"]).select("doc_id", "fp", "component_id")
    return rows.unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; rows without doc_id stay."""
    kept = near_fingerprints(docs, **params).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
