"""A saved inverted index, and exact BM25 lists from it without scoring what cannot reach them.

``build_index`` tokenizes every text once, counts it where it lies and packs the postings of a batch of documents by term;
nothing is shuffled.  A block is the documents of a batch, so a term that every document holds is many rows and no task of its
own, and packed rows grow with the documents; the table is partitioned by a hash of the term and sorted by it within a file, and a
question reads its terms' partitions.

A list of k comes in four steps, for all questions and settings at once.  (1) Statistics over readable documents.  (2) The
rarest terms of a question, until 4 k documents hold one, give partial scores; weights are not negative, so the k-th of them
is a score that the list's last row reaches.  (3) Terms whose greatest weights together stay below it cannot bring a document
into the list alone; a question reads the blocks in which another of its terms has a greatest weight that, with those of its
other terms, reaches it.  (4) A part of a block and a slice of the questions meet in a task, where documents are scored in full,
in the order of their terms, so a score is the same whatever was skipped; what is shuffled then is about k rows a question
and part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.storage import exists, saved, scratch

BUCKETS = 16
PARTS = 4  # a block's documents are scored in so many parts
SLICE = 2_000  # questions, times settings, that a task scores


@dataclass
class Index:
    """postings(bucket, term, block, paths, tfs, dls): arrays of one length, several rows a block; and lengths(path, dl), a row
    for each document."""

    postings: DataFrame
    lengths: DataFrame


def _bucket(term: str) -> Column:
    return F.when(F.col(term).isNotNull(), F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """term, block, paths, tfs, dls of (path, task, tokens): the postings of a batch of documents, packed by term and block
    (``size`` of its documents at most), and a row without a term that has the lengths of all of them."""
    names = ["term", "block", "paths", "tfs", "dls"]
    base = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, tokens, blocks = batch.column(0), batch.column(2), np.arange(batch.num_rows) // size
        base = base or int(batch.column(1)[0].as_py()) << 32
        dl = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32())
        whole = pa.array([0, batch.num_rows], pa.int32())
        lists = lambda at, values: pa.ListArray.from_arrays(at, values)
        none = pa.array(np.zeros(batch.num_rows, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([-1], pa.int64()), lists(whole, paths), lists(whole, none), lists(whole, dl)], names=names)
        words = pc.dictionary_encode(tokens.flatten())
        kinds = max(1, len(words.dictionary))
        of = np.repeat(np.arange(batch.num_rows), dl.to_numpy())
        pairs, tf = np.unique(of * kinds + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc = pairs // kinds
        key = blocks[doc] * np.int64(kinds) + pairs % kinds
        order = np.argsort(key, kind="stable")
        key, doc, tf = key[order], doc[order], tf[order].astype(np.int32)
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        at = pa.array(np.append(heads, len(key)).astype(np.int32))
        doc = pa.array(doc)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key[heads] % kinds)), pa.array(base + key[heads] // kinds), lists(at, paths.take(doc)), lists(at, pa.array(tf)), lists(at, dl.take(doc))], names=names)
        base += int(blocks[-1]) + 1


def build_index(docs: DataFrame, root: str | None = None, doc: str = "path", text: str = "text", block: int = 16_384) -> Index:
    """The index of ``docs``, in a folder; documents without tokens have length 0.

    ``block`` is how many documents a block has at most; a block ends with its Arrow batch.
    """
    spark = docs.sparkSession
    root = root or scratch(spark, "index")
    kind = docs.schema[doc].dataType.simpleString()
    tokens = docs.select(F.col(doc).alias("path"), F.spark_partition_id().alias("task"), tx.tokenize(text).alias("tokens"))
    rows = tokens.mapInArrow(lambda batches: _packed(batches, block), f"term string, block long, paths array<{kind}>, tfs array<int>, dls array<int>")
    # nothing is shuffled: a task writes a sorted file a bucket
    rows.withColumn("bucket", F.coalesce(_bucket("term"), F.lit(-1))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/postings")
    return open_index(spark, root, kind)


def open_index(spark: SparkSession, root: str, kind: str) -> Index:
    """The index in a folder; ``kind`` is the type of its paths."""
    rows = spark.read.schema(f"term string, block long, paths array<{kind}>, tfs array<int>, dls array<int>, bucket int").parquet(f"{root}/postings")
    lengths = rows.where("bucket = -1").select(F.explode(F.arrays_zip("paths", "dls")).alias("x")).select(F.col("x.paths").alias("path"), F.col("x.dls").alias("dl"))
    return Index(rows.where("bucket >= 0"), lengths)


def index_of(docs: DataFrame, name: str) -> Index:
    """The index of documents that come from files: built once by an application for their present state."""
    spark = docs.sparkSession
    state = [spark.sparkContext.applicationId]
    for f in sorted(docs.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        state.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    base = scratch(spark, "x").rsplit("/", 1)[0]
    root = f"{base}/index-{name}-{hashlib.sha256('|'.join(state).encode()).hexdigest()[:24]}"
    if exists(spark, f"{root}/postings/_SUCCESS"):
        return open_index(spark, root, docs.schema["path"].dataType.simpleString())
    return build_index(docs, root if not exists(spark, root) else None)


def _settings(configs: DataFrame) -> DataFrame:
    return configs.select("hash", F.col("bm25_k1").cast("double").alias("k1"), F.col("bm25_b").cast("double").alias("b"), F.col("top_k").cast("int").alias("k")).distinct()


def _weight(tf: str, dl: str) -> Column:
    tf, dl = F.col(tf), F.col(dl)
    return F.col("idf") * tf * (F.col("k1") + 1) / (tf + F.col("k1") * (1 - F.col("b") + F.col("b") * dl / F.col("avgdl")))


def _scorer(margin: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """(postings of a part of a block, terms of a slice of questions) to pair, path, s: of each question the k best documents
    of the part, and those within ``margin`` of the k-th, which rounding could put before it."""

    def score(held: pd.DataFrame, reads: pd.DataFrame) -> pd.DataFrame:
        if held.empty or reads.empty:
            return pd.DataFrame({"pair": np.array([], np.int64), "path": held["path"].iloc[:0], "s": np.array([], float)})
        held, reads = held.sort_values("tid"), reads.sort_values(["pair", "term"])
        doc, paths = pd.factorize(held["path"], sort=True)
        tf, dl = held["tf"].to_numpy(float), held["dl"].to_numpy(float)
        tid = held["tid"].to_numpy()
        head, end = (np.searchsorted(tid, reads["tid"].to_numpy(), side) for side in ("left", "right"))
        idf, avgdl, k1, b, reach = (reads[c].to_numpy(float) for c in ("idf", "avgdl", "k1", "b", "reach"))
        pair, k = reads["pair"].to_numpy(), reads["k"].fillna(0).to_numpy(int)
        bounds = np.append(np.flatnonzero(np.diff(pair, prepend=pair[0] - 1)), len(pair))
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            n = end[lo:hi] - head[lo:hi]
            at = np.arange(n.sum()) + np.repeat(head[lo:hi] - np.cumsum(n) + n, n)
            q = np.repeat(np.arange(lo, hi), n)
            w = idf[q] * tf[at] * (k1[q] + 1) / (tf[at] + k1[q] * (1 - b[q] + b[q] * dl[at] / avgdl[q]))
            s = np.bincount(doc[at], w, len(paths))  # adds in the order of terms
            hit = np.flatnonzero((s > 0) & (s >= reach[lo]))
            hit = hit[np.lexsort((hit, -s[hit]))]  # numbers of documents are in the order of paths
            if len(hit) > k[lo] > 0:
                hit = hit[s[hit] >= s[hit[k[lo] - 1]] - margin]
                first = np.flatnonzero(np.diff(s[hit], prepend=np.inf))
                nth = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
                hit = hit[nth < k[lo]]  # of equal scores the first k paths are enough
            out.append((np.full(len(hit), pair[lo]), hit, s[hit]))
        pair, hit, s = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"pair": pair, "path": paths.take(hit), "s": s})

    return score


def bm25_lists(questions: DataFrame, index: Index, readable: DataFrame, configs: DataFrame, digits: int | None = None) -> DataFrame:
    """hash, qid, path, score > 0, rank: the first ``top_k`` documents of ``questions(qid, acl_key, text)`` for each of
    ``configs(hash, bm25_k1, bm25_b, top_k)``, by score (rounded to ``digits``), then path."""
    margin = 2 * 10.0**-digits if digits else 1e-9
    asked = questions.select("qid", "acl_key", F.explode(F.array_distinct(tx.tokenize("text"))).alias("term"))
    terms = saved(asked.select("term").distinct().withColumn("bucket", _bucket("term")).withColumn("tid", F.monotonically_increasing_id()), "asked")
    few = index.postings.join(terms, ["bucket", "term"]).select("tid", "block", F.explode(F.arrays_zip("paths", "tfs", "dls")).alias("d")).select("tid", "block", F.col("d.paths").alias("path"), F.col("d.tfs").alias("tf"), F.col("d.dls").alias("dl"))
    asked = asked.join(terms.select("term", "tid"), "term")
    keys = readable.select("acl_key", "path").distinct().join(questions.select("acl_key").distinct(), "acl_key", "left_semi")
    seen = saved(few.join(keys, "path").select("acl_key", "tid", "block", "path", "tf", "dl"), "seen")
    size = keys.join(index.lengths, "path").groupBy("acl_key").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    bounds = saved(seen.groupBy("acl_key", "tid", "block").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"), F.min("dl").alias("least")), "blocks")
    stats = bounds.groupBy("acl_key", "tid").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")).join(size, "acl_key")
    stats = stats.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("n")

    # a row for each setting, question and term that a readable document holds
    each = asked.join(stats, ["acl_key", "tid"]).crossJoin(_settings(configs)).where("idf > 0").withColumn("top", _weight("most", "least"))
    of = Window.partitionBy("hash", "qid")
    rarest = of.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    each = saved(each.withColumn("docs_before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).withColumn("all_tops", F.sum("top").over(of)), "terms")

    # from here on a number stands for a setting and question: rows of it and a path are what is shuffled
    pairs = saved(each.select("hash", "qid", "k").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    each = each.join(pairs.drop("k"), ["hash", "qid"])
    of, key = Window.partitionBy("pair"), ["pair", "path"]
    most = configs.agg(F.coalesce(F.max("top_k"), F.lit(0)).alias("k")).first().k

    def reached(partial: DataFrame) -> DataFrame:
        """pair, reach: the k-th of partial scores, a score that the list's last row has at least."""
        nth = F.row_number().over(of.orderBy(F.desc("s"), "path"))
        best = partial.withColumn("nth", nth).where(F.col("nth") <= int(most)).join(pairs.select("pair", "k"), "pair")
        return best.where("nth = k").select("pair", (F.col("s") - margin).alias("reach"))

    first = each.where("docs_before < 4 * k").select("pair", "acl_key", "tid", "idf", "avgdl", "k1", "b").join(seen, ["acl_key", "tid"])
    reach = reached(first.groupBy(*key).agg(F.sum(_weight("tf", "dl")).alias("s")))
    each = each.join(reach, "pair", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
    each = each.withColumn("low", F.sum("top").over(of.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)))
    each = saved(each.withColumn("needed", F.col("low") >= F.col("reach")), "terms")

    blocks = each.where("needed").join(bounds.select("acl_key", "tid", "block", F.col("most").alias("m"), F.col("least").alias("l")), ["acl_key", "tid"])
    blocks = blocks.where(_weight("m", "l") + F.col("all_tops") - F.col("top") >= F.col("reach")).select("pair", "block").distinct()
    slices = max(1, -(-pairs.count() // SLICE))
    places = ["acl_key", "block", "part", "slice"]
    reads = each.join(blocks, "pair").select(
        "acl_key", "block", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.pmod(F.xxhash64("pair"), F.lit(slices)).cast("int").alias("slice"),
        "pair", "term", "tid", "idf", "avgdl", "k1", "b", "k", "reach")
    part = F.pmod(F.xxhash64("path", F.lit("part")), F.lit(PARTS)).cast("int")
    held = seen.select("acl_key", "block", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "tid", "path", "tf", "dl")
    kind = seen.schema["path"].dataType.simpleString()
    scored = held.groupBy(*places).cogroup(reads.groupBy(*places)).applyInPandas(_scorer(margin), f"pair long, path {kind}, s double")
    rows = scored.select(*key, (F.round("s", digits) if digits else F.col("s")).alias("score")).where("score > 0")
    rank = F.row_number().over(of.orderBy(F.desc("score"), "path"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= int(most)).join(pairs, "pair").where("rank <= k").select("hash", "qid", "path", "score", "rank")


def bm25_topk(questions: DataFrame, index: Index, readable: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """qid, path, score, rank: the k best readable documents of each question."""
    one = questions.sparkSession.range(1).select(F.lit("").alias("hash"), F.lit(k1).alias("bm25_k1"), F.lit(b).alias("bm25_b"), F.lit(k).alias("top_k"))
    return bm25_lists(questions, index, readable, one, digits).drop("hash")
