"""What filters do to a corpus in every order, counted with wide packed integers.

A document's failed filters are a mask.  A mask (with the document's labels) fixes what happens to it at every step of
every order of the filters, so a table maps each mask to one big integer that has a 64-bit field for each counter of each
step: 120 orders of five filters are 600 steps, with six counters each.  Adding integers adds all fields at once; a field
holds up to 2**64 - 1, more than a table has rows, so no field flows over into the next.  Tasks add up their rows' integers
by part, the sums of tasks are added in two levels, and a part's integer is unpacked into rows at the end.

"Identical to a smaller doc_id's text" is decided table-wide before that: rows are counted by text digest, part and labels
(combined within tasks, so copies of one text cost a row a task), and a digest's smallest doc_id is the only one that
passes.  Texts with one SHA-256 count as equal.

Defined results: null texts are empty (0 words; they are identical to each other); null parts are ''; rows without doc_id
are identical to nothing and have no labels; rows that repeat a doc_id and text are counted each and are not identical to
each other; a label row with another value than 1, or none, is no label; of repeated label rows any with 1 counts; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, summed, table

COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: parts whose sums a task holds at a time
_HELD = 256


def orders(filters: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def outcomes(mask: int, good: bool, toxic: bool, filters: str) -> np.ndarray:
    """(orders, steps, counters) of zeros and ones: what becomes of a document that fails the filters of ``mask``."""
    out = np.zeros((len(orders(filters)), len(filters), len(COUNTERS)), np.uint8)
    for i, order in enumerate(orders(filters)):
        gone = False
        for j, name in enumerate(order):
            bit = 1 << filters.index(name)
            here = bool(mask & bit) and not gone
            redundant = bool(mask & bit) and gone
            gone |= here
            out[i, j] = (not gone, here, redundant, mask == bit, here and good, here and toxic)
    return out


def packed(filters: str) -> dict[tuple[int, bool, bool], int]:
    """The big integer of each mask and pair of labels, a 64-bit field for each counter of each step."""
    flags = (False, True)
    return {(m, g, t): int.from_bytes(outcomes(m, g, t, filters).astype("<u8").tobytes(), "little") for m in range(1 << len(filters)) for g in flags for t in flags}


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, the counters and shapley of ``counts(part, mask, good, toxic, n)``: n documents each."""
    size = 8 * len(COUNTERS) * len(filters) * len(orders(filters))
    unpack, pack = lambda b: int.from_bytes(b, "little"), lambda v: v.to_bytes(size, "little")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, held = packed(filters), {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([pack(v) for v in held.values()], pa.binary())], names=["part", "total"])
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in held and len(held) == _HELD:
                    yield out()
                    held.clear()
                held[part] = held.get(part, 0) + n * fields[mask, good, toxic]
        if held:
            yield out()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps = orders(filters), len(filters)
        at = np.array([[filters.index(x) for x in order] for order in names])
        for batch in batches:
            for part, total in zip(batch.column(0).to_pylist(), batch.column(1)):
                fields = np.frombuffer(total.as_py(), "<u8").reshape(len(names), steps, len(COUNTERS)).astype(np.int64)
                removed = fields[:, :, COUNTERS.index("removed")]
                shapley = np.array([removed[at == k].sum() for k in range(steps)])[at]
                columns = [pa.array([part] * shapley.size, pa.string()), pa.array(np.repeat(names, steps).tolist(), pa.string()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
                columns += [pa.array(fields[:, :, k].ravel()) for k in range(len(COUNTERS))] + [pa.array(shapley.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTERS, "shapley"])

    sums = counts.select("part", "mask", "good", "toxic", "n").mapInArrow(add, "part string, total binary")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    return summed(sums, unpack, pack, ("part",)).mapInArrow(rows, schema)


def text_failures(text: Column | str = "text") -> Column:
    """Bits of the filters A to D: few words, few different words, many capitals, odd signs."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 3 * F.length(t).cast("long"),
        t.rlike("[#$%&*|]"),
    )
    mask = F.lit(0)
    for k, bad in enumerate(fails):
        mask = mask + F.when(bad, 1 << k).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", repeated: int = 16, salts: int = 1024) -> DataFrame:
    """part, mask, good, toxic, n: how many documents there are of each text, part and labels, by whether they repeat the
    text of a smaller doc_id (the bit ``repeated``)."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    seen = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("same"), text_failures().alias("mask"))
    # rows without an id join nothing; they are spread, lest they meet in one task
    seen = seen.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("same", F.spark_partition_id()), F.lit(salts))).otherwise(0))
    rows = seen.groupBy("doc_id", "spread", "same", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread", F.lit(0))
    no = F.lit(False)
    rows = rows.join(marks, ["doc_id", "spread"], "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    named = F.col("doc_id").isNotNull()
    groups = rows.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    groups = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("same")))
    passed = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - passed).alias("n"))))
    return groups.select("part", "good", "toxic", both.alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
+ CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
b AS (SELECT filter_order, step, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
sum(CASE WHEN good AND mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN toxic AND mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM m, b GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""
