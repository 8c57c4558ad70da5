"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, pseudorandom index permutations.

Words of each source are packed into blocks of ``block`` words.  The output is a row of slots in shards.  How many slots
of each source a shard has is drawn from a multinomial: a source's slots fall on the shards with equal chances, so all
shards together give each source its exact share.  The counts are a table, a row for each source and shard that has
slots of it.  The j-th slot of a source reads block ``perm(j mod n)`` of the source's ``n`` blocks, a keyed permutation per
pass, and slots are joined with blocks by that index; a permutation of the shard's slots mixes the sources in it.  The
last slot of a source is cut so that its words meet the target exactly.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, 2, 1, …; they share ``share`` times all words, no source
above ``most`` times its own; what exceeds that goes to the others by weight until none is above.

Defined results: null and empty texts have size 0 and are never taken; rows that repeat a ``doc_id`` are rows of their
own; a source without words has target 0; an empty table gives an empty result; extra columns are ignored by
``mix_plan`` and carried by ``mix_documents``.  Only a row per source is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, new_name, saved, small_batches, table

CYCLE = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Water filling of ``share * sum(sizes)`` by weight under the ceilings ``most * size``."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


_ROUNDS = [np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(4)]


def _scramble(b: np.ndarray, key: np.ndarray, step: np.uint64, mask: np.ndarray) -> np.ndarray:
    f = (b + key + step) * np.uint64(0xBF58476D1CE4E5B9)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (f ^ (f >> np.uint64(32))) & mask


def permute(x, n, key, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of ``0..n-1`` by a four-round Feistel network with cycle walking, elementwise."""
    x, n, key = (np.atleast_1d(np.asarray(v, np.uint64)) for v in (x, n, key))
    half = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo, out = np.arange(len(x)), x.copy()
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = v >> h, v & m
        for step in reversed(_ROUNDS) if inverse else _ROUNDS:
            a, b = (b ^ _scramble(a, k, step, m), a) if inverse else (b, a ^ _scramble(b, k, step, m))
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(seed: int, source, turn) -> np.ndarray:
    source, turn = np.atleast_1d(np.asarray(source, np.uint64)), np.atleast_1d(np.asarray(turn, np.uint64))
    return (source * np.uint64(0x9E3779B97F4A7C15)) ^ (turn * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(seed)


def _slots_of(i: int, size: int, want: int, block: int, seed: int) -> tuple[int, int]:
    """How many slots source ``i`` gets for ``want`` words, and how many words the last of them takes (0: all)."""
    if not want:
        return 0, 0
    n = -(-size // block)
    tail = size - (n - 1) * block
    turns, rest = divmod(want, size)
    if not rest:
        return turns * n, 0
    short = int(permute(n - 1, n, _key(seed, i, turns), inverse=True)[0])  # the slot of the short last block in this turn
    words = lambda k: k * block - (block - tail) * (short < k)
    k = -(-rest // block)
    k += words(k) < rest
    return turns * n + k, (tail if short == k - 1 else block) - (words(k) - rest)


def shard_counts(source: int, slots: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, counts): a multinomial draw of a source's slots over the shards, those without any left out."""
    rng = np.random.default_rng([seed, source])
    if slots < shards:
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    counts = rng.multinomial(slots, np.full(shards, 1 / shards))
    return np.flatnonzero(counts), counts[counts > 0]


def mix_plan(docs: DataFrame, block: int = 128, share: float = 1.5, most: float = 2.0, seed: int = 7, max_shards: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(documents, taken pieces).

    documents: row_key, doc_id, source, size, source_size, target; a row for each row of ``docs``.
    pieces: row_key, shard, slot, word_from, words: the words of a document that a slot takes, from ``word_from`` on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = saved(rows, "mix-sizes")
    per = sorted(((r["source"], int(r["size"] or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes, weights = [r[1] for r in per], [CYCLE[i % len(CYCLE)] for i in range(len(per))]
    goal = targets(sizes, weights, share, most)
    drawn = [_slots_of(i, s, min(round(g), int(most * s)), block, seed) for i, (s, g) in enumerate(zip(sizes, goal))]
    shards = max(1, min(max_shards, sum(d[0] for d in drawn) // 4096))

    info = spark.createDataFrame([(i, p[0], p[1], float(g)) for i, (p, g) in enumerate(zip(per, goal))], "src int, source string, source_size long, target double")
    # positions: a running sum inside chunks of a source (by hash, so that a hot source is spread), then over the chunks
    parts = max(1, rows.count() // 2_000)
    few = F.broadcast(info) if len(per) <= 100_000 else info
    rows = rows.join(few, rows["source"].eqNullSafe(info["source"])).drop(info["source"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)))
    chunks = rows.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("src", "chunk", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "chunk").orderBy("doc_id", "h", "size")
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(inside))
    documents = saved(
        placed.join(chunks, ["src", "chunk"]).select(F.struct("src", "chunk", "nth").alias("row_key"), "doc_id", "source", "h", "size", "source_size", "target", "src", (F.col("base") + F.col("before")).alias("start")),
        "mix-rows",
    )

    # a piece is the part of a document in a block
    piece = documents.where("size > 0").select("row_key", "src", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    piece = piece.select("row_key", "src", "block", (lo - F.col("block") * block).alias("at"), (lo - F.col("start")).alias("word_from"), (hi - lo).alias("n"))

    slots = _slots(spark, [(i, -(-s // block), *d) for i, (s, d) in enumerate(zip(sizes, drawn)) if d[0]], shards, block, seed)
    # join blocks by index; the last slot of a source is cut to its words
    words = F.least("n", F.greatest(F.col("limit") - F.col("at"), F.lit(0)))
    # both sides have a row a block, far more than the sizes of what they are made of say: neither is ever broadcast
    pieces = piece.join(slots.hint("merge"), ["src", "block"]).select("row_key", "shard", "slot", "word_from", words.alias("words")).where("words > 0")
    return documents, pieces


def _slots(spark: SparkSession, sources: list[tuple[int, int, int, int]], shards: int, block: int, seed: int) -> DataFrame:
    """shard, slot, src, block, limit: a row for each slot of the output.  sources: (source, blocks, slots, last)."""
    names = ("src", "n_blocks", "n_slots", "last")
    columns = "src int, n_blocks long, n_slots long, last long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, n = shard_counts(row["src"], row["n_slots"], shards, seed)
                same = [pa.array(np.full(len(n), row[c])) for c in names]
                yield pa.RecordBatch.from_arrays([same[0].cast(pa.int32()), *same[1:], pa.array(shard), pa.array(n), pa.array(np.cumsum(n) - n)], names=[*names, "shard", "n", "base"])

    dealt = spark.createDataFrame(sources, columns).mapInArrow(deal, f"{columns}, shard long, n long, base long")
    # a source's place in its shard, then pieces of up to 65,536 slots, so that a large count is spread
    shard = Window.partitionBy("shard")
    before = F.sum("n").over(shard.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    dealt = dealt.withColumn("offset", before).withColumn("in_shard", F.sum("n").over(shard))
    # few bytes become many slots, so the tasks are by number of slots
    tasks = max(1, -(-sum(s[2] for s in sources) // (1 << 16)))
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (1 << 16))))).repartition(tasks, "shard", "src", "piece")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k = np.arange(r["piece"] << 16, min(r["n"], (r["piece"] + 1) << 16))
                place = permute(r["offset"] + k, np.full(len(k), r["in_shard"]), np.repeat(_key(seed, r["shard"], 1 << 20), len(k)))
                j, n = r["base"] + k, r["n_blocks"]
                at = permute(j % n, np.full(len(k), n), _key(seed, np.full(len(k), r["src"]), j // n))
                limit = np.where((j == r["n_slots"] - 1) & (r["last"] > 0), r["last"], block)
                cols = [np.full(len(k), r["shard"]), place, np.full(len(k), r["src"], np.int32), at, limit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["shard", "slot", "src", "block", "limit"])

    return dealt.mapInArrow(expand, "shard long, slot long, src int, block long, limit long")


def mix_counts(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``."""
    documents, pieces = mix_plan(docs, **params)
    taken = pieces.groupBy("row_key").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row_key", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(at: int, names: list[str]):
    """Column ``at`` cut to the word ranges of the last column, which goes."""
    import re

    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist()):
                spans = [m.span() for m in word.finditer(text)]
                out.append("\n".join(text[spans[r["a"]][0] : spans[r["b"] - 1][1]] for r in ranges))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return run


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus as rows of ``docs``: the words that the mix takes of each document, whole runs in their order,
    a second turn after the first; documents that it takes nothing of are left out.  ``n_chars``, if there, follows.
    Rows alike in id, source and text are told apart by a hash of their other columns."""
    documents, pieces = mix_plan(docs, **params)
    # touching pieces of one turn make a run; the turn of a piece is how often the mix took its first word before
    turn = Window.partitionBy("row_key", "word_from").orderBy("shard", "slot")
    order = Window.partitionBy("row_key", "turn").orderBy("word_from")
    runs = pieces.withColumn("turn", F.row_number().over(turn)).withColumn("gap", F.when(F.lag(F.col("word_from") + F.col("words")).over(order) == F.col("word_from"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("gap").over(order)).groupBy("row_key", "turn", "run").agg(F.min("word_from").alias("a"), F.max(F.col("word_from") + F.col("words")).alias("b"))
    ranges = runs.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b"))).alias("ranges"))
    # of rows alike in doc_id, source and text, the k-th takes the ranges of the k-th in the plan
    same = Window.partitionBy("doc_id", "source", "h").orderBy("row_key")
    # the file of all rows is small beside the rows, and would be broadcast by its size
    ranges = documents.select("row_key", "doc_id", "source", "h", F.row_number().over(same).alias("k")).hint("merge").join(ranges, "row_key").drop("row_key")
    d, s, h, k, r, mine, nth = (new_name(docs, f"mix_{c}") for c in ("d", "s", "h", "k", "ranges", "hash", "nth"))
    ranges = ranges.toDF(d, s, h, k, r)
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    left = docs.withColumn(mine, F.xxhash64("text"))
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", mine).orderBy(F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0))))
    joined = left.join(ranges, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(mine) == F.col(h)) & (F.col(nth) == F.col(k)))
    schema = docs.schema
    out = joined.select(*docs.columns, r).mapInArrow(_cut(docs.columns.index("text"), docs.columns), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
