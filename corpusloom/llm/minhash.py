"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations give every signature coordinate: a shingle's place in the universe goes through the first, and
coordinate ``k`` is the least value of the second permutation read ``k`` places further on, circularly.  Documents with
equal shingle sets form a class; class representatives that agree on a band are candidates; links are confirmed on full
shingle sets of 64-bit hashes (a false match of one shingle pair has probability 2**-64).

Candidates of a band's bucket are not multiplied out: everyone is compared with the bucket's least document, then with
a drawn member of another component.  Documents of buckets that are still of several components are then joined by
prefix filtering: shingles in one order for all (rarest first, by a fixed-size table of counts), two sets at the
similarity share a shingle of their prefixes, at places and with sizes that leave the overlap possible.  Pairs of one
component are skipped there, so components are those of all verified links.

With the defaults (42 bands of 6) a pair at similarity 0.8 shares no band with probability 3e-6, at 0.9 with 2e-14.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; texts with fewer words
than a shingle have one, their whole sequence; rows that repeat a ``doc_id`` count as one node; rows with a null
``doc_id`` take no part (null component, kept); extra columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_worker_cache, new_name, saved, small_batches, summed, table
from corpusloom.llm.graph import components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    n = len(h) - size + 1
    if n < 1:
        n, size = 1, len(h)
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = _mix(acc * _A + h[j : j + n])
    return np.unique(acc)


@lru_cache(maxsize=2)
def _permutations(universe: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all circular windows of the second."""
    rng = np.random.default_rng(seed)
    first, second = rng.permutation(universe).astype(np.int64), rng.permutation(universe).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)


def signature(hashes: np.ndarray, coordinates: int, universe: int = 1 << 20, seed: int = 11) -> np.ndarray:
    first, windows = _permutations(universe, coordinates, seed)
    places = first[(hashes >> np.uint64(11)).astype(np.int64) % universe]
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(out, windows[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _C
    for j in range(rows.shape[1]):
        acc = _mix(acc * _A + rows[:, j])
    return acc.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of ``step`` rows, so that few rows exist as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (fingerprint of the whole set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for batch in slices(batches):
            n, k1, k2, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                print_ = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s))
                k1.append(int(print_[0]))
                k2.append(int(print_[1]))
                keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
            flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
            offsets = np.cumsum([0, *(0 if k is None else bands for k in keys)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles binary")


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        common, either = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            k = int(np.count_nonzero(both[1:] == both[:-1]))
            common.append(k)
            either.append(len(both) - k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "either"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, either: exact sizes of intersection and union."""
    joined = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(_intersect, "a long, b long, common long, either long")


def _counts(sets: DataFrame, cells: int, slices: int = 32) -> np.ndarray:
    """How many sets have a shingle of each hash cell: each task counts its own, slices of the counts are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount((np.frombuffer(x, np.uint64) % np.uint64(cells)).astype(np.int64), minlength=cells)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in np.split(total, slices)], pa.binary())], names=["slice", "total"])

    own = sets.select("shingles").mapInArrow(count, "slice int, total binary")
    parts = summed(own, lambda b: np.frombuffer(bytes(b), np.int64), lambda v: v.tobytes(), ("slice",)).collect()
    return np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(parts, key=lambda r: r["slice"])]) if parts else np.zeros(cells, np.int64)


def _prefix_pairs(apart: DataFrame, percent: int, cells: int = 1 << 18) -> DataFrame:
    """Pairs a < b of ``apart(doc, label, shingles)`` with different labels that may be at the similarity (none is missed)."""
    common = apart.sparkSession.sparkContext.broadcast(_counts(apart, cells))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, labels, shingles_, places, sizes = [], [], [], [], []
            for doc, label, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = np.frombuffer(packed, np.uint64)
                n = len(h)
                k = n - -(-n * percent // 100) + 1
                order = np.lexsort((h, common.value[(h % np.uint64(cells)).astype(np.int64)]))[:k]
                docs.append(np.full(k, doc)), labels.append(np.full(k, label)), sizes.append(np.full(k, n))
                shingles_.append(h[order].view(np.int64)), places.append(np.arange(k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, labels, shingles_, places, sizes)], names=["doc", "label", "s", "place", "n"])

    rows = saved(apart.select("doc", "label", "shingles").mapInArrow(prefixes, "doc long, label long, s long, place long, n long"), "prefixes")
    by_label = rows.groupBy("s", "label").count()
    top = by_label.groupBy("s").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    rows = saved(rows.join(top, "s"), "prefixes")
    # of two different labels one is not the shingle's most frequent, so that one's rows against all are enough
    few = rows.where("label <> top").select("s", *(F.col(c).alias(f"{c}2") for c in ("doc", "label", "place", "n")))
    overlap = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) - 1
    possible = (F.col("label") != F.col("label2")) & (overlap * (100 + percent) >= percent * (F.col("n") + F.col("n2")))
    joined = rows.drop("top").join(few, (rows["s"] == few["s"]) & possible)
    return joined.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, drawn_rounds: int = 1, salts: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    Rows of equal sets meet their class in ``salts`` parts, so a class that holds a large share of all rows is no task
    of its own; only the class representative's bands go on.
    """
    sketch = saved(sketches(docs.where("doc_id is not null"), size, bands, rows).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "sketches")
    parts = saved(sketch.where("n_shingles > 0").groupBy("k1", "k2", "salt").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least")), "class-parts")
    classes = parts.groupBy("k1", "k2").agg(F.min("least").alias("least")).select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.n_shingles").alias("n"), F.col("least.bands").alias("bands"))
    classes = saved(classes, "classes")
    placed = classes.select(F.col("rep").alias("doc"), "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("centre")).where("c > 1").drop("c")
    members = saved(placed.join(shared, "key"), "members")
    sets = saved(_sets(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members.select("doc").distinct(), "doc", "left_semi"), size), "sets")

    alike = F.col("common") * 100 >= F.col("either") * percent
    first = members.where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    tested = saved(_verify(first, sets), "tested")
    links = tested.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v"))
    for k in range(drawn_rounds + 1):
        labels = components(links)
        now = members.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("doc", F.lit(k)).alias("draw"), "doc", "n", "label")).alias("x")).where("lo < hi and c > 2")
        if k < drawn_rounds:  # everyone against one drawn member of the bucket
            other = now.join(mixed.select("key", "x"), "key").where("label <> x.label and least(n, x.n) * 100 >= greatest(n, x.n) * " + str(percent))
            pairs = other.select(F.least("doc", "x.doc").alias("a"), F.greatest("doc", "x.doc").alias("b")).distinct()
        else:  # what is still apart
            apart = now.join(mixed.select("key"), "key", "left_semi").select("doc", "label").distinct()
            pairs = _prefix_pairs(saved(apart.join(sets, "doc"), "apart"), percent)
        more = saved(_verify(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets), "tested")
        tested = tested.union(more)
        links = links.union(more.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = components(links)
    named = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("label"))
    named = parts.select("k1", "k2", "salt").join(named, ["k1", "k2"])
    out = sketch.select("doc_id", "n_shingles", "k1", "k2", "salt").join(named, ["k1", "k2", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    absent = sketches(docs.where("doc_id is null"), size, bands, rows).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(absent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` whose document has the least ``doc_id`` of its component.  Of rows that repeat it, the one
    with the least hash of its text stays; rows alike in id and text are alike for this operator, and any one stays."""
    found = near_duplicates(docs, **params)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    order, at = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"), new_name(docs, "nth")
    rows = docs.join(kept, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(order).alias(at)).where(F.col(at) == 1).drop(at)
    return rows.unionByName(docs.where("doc_id is null"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
