"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Text is read as UTF-8 bytes: ASCII letters are lower-cased, ASCII bytes that are neither letters nor digits become
spaces, so a word is a run of the rest.  Patterns are windows of ``window`` consecutive words of an item (all its words,
if fewer), each between spaces; a text is scanned once, and matches are mapped to word numbers and character offsets of
the original.  A benchmark of over ``block_chars`` pattern characters is read in blocks by a hash of the item: for each
block in turn a job of its own scans all texts with that block's automaton and writes the matches to the shared folder,
so neither the driver nor a task ever holds more than one block (or one item, if that is longer).  Matches belong to a
text, not to a row: they are joined to the rows by the text's SHA-256.

Defined results: null, empty and wordless texts have no words and no hits; items without words match nothing; repeated
rows give repeated rows; items with a null id mark words but are not listed; extra columns are ignored, whatever their
names, and carried with ``drop``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import new_name, saved, small_batches, table, worker_cache

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows_of(text: str | None, window: int) -> set[str]:
    """The patterns of an item, as Latin-1 views of UTF-8 bytes."""
    words = words_of(text)
    if not words:
        return set()
    n = max(1, len(words) - window + 1)
    return {(b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1") for i in range(n)}


class Matcher:
    """The automaton of a block of patterns: ``pattern -> item ids``."""

    def __init__(self, patterns: dict[str, list]):
        import ahocorasick

        self.items = list(patterns.values())
        self.lengths = [len(p) for p in patterns]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()

    def scan(self, joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, pattern) of all matches in ``joined``, in bytes of it."""
        if not self.items:
            return []
        return [(end - self.lengths[k] + 1, end, k) for end, k in self.automaton.iter(joined.decode("latin-1"))]


def _matcher(patterns) -> Matcher:
    return worker_cache("matcher", str(patterns.value[0]), lambda: Matcher(patterns.value[1]))


def pattern_blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[dict[str, list]]:
    """Patterns in blocks of about ``block_chars``, by hash of the item; each block alone is held by the driver."""
    items = benchmark.select(F.col("item_id"), F.col("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total * (window + 1) // block_chars
    for b in range(n):
        block: dict[str, list] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toLocalIterator():
            for p in windows_of(row["text"], window):
                block.setdefault(p, []).append(row["item_id"])
        yield {p: sorted({x for x in ids if x is not None}, key=str) for p, ids in block.items()}


def _original_offsets(text: str, first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Character ranges in ``text`` of the word ranges first..last (inclusive)."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b]])) for a, b in zip(first, last)]


def _fingerprint(block: dict[str, list]) -> str:
    """A key of all patterns of a block and their items."""
    h = hashlib.sha1()
    for p in sorted(block):
        h.update(f"{p}\x00{block[p]}\x00".encode())
    return h.hexdigest()


def _found(m: Matcher, text: str | None) -> tuple[list[int], list[str]]:
    """(word ranges first, last, first, last, …; ids of the items) of a text's matches."""
    joined = b" " + b" ".join(words_of(text)) + b" "
    found = m.scan(joined)
    if not found:
        return [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    ranges = np.searchsorted(blanks, np.array([f[:2] for f in found]))
    ranges[:, 1] -= 1
    return np.unique(ranges, axis=0).ravel().tolist(), sorted({str(x) for f in found for x in m.items[f[2]]})


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 10_000_000, drop: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans: the words inside matches, the items they come from, and merged character
    ranges [start, end) in the original text.  With ``drop`` the input rows without a hit are returned instead."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    blocks = pattern_blocks(benchmark, window, block_chars)
    block, after = next(blocks), next(blocks, None)
    if after is None:  # one automaton: one pass over the rows
        patterns = share((_fingerprint(block), block))
        if drop:
            return docs.mapInArrow(_clean(patterns, docs.columns.index("text")), docs.schema)
        found = docs.select("doc_id", "text").mapInArrow(_report(lambda text, batch, i, m=patterns: _found(_matcher(m), text)), _schema(docs))
    else:
        texts, hits = docs.select("text").where("text is not null"), None
        while block is not None:
            part = texts.mapInArrow(_matches(share((_fingerprint(block), block))), "key string, hits array<int>, items array<string>")
            part = saved(part.dropDuplicates(["key"]), "matches")
            hits, block, after = part if hits is None else hits.union(part), after, next(blocks, None)
        key = F.sha2(docs["text"].cast("binary"), 256)
        if drop:
            name = new_name(docs, "key")
            return docs.join(hits.select(F.col("key").alias(name)).distinct(), key == F.col(name), "left_anti")
        per = hits.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        rows = docs.select("doc_id", "text")
        rows = rows.join(per, F.sha2(rows["text"].cast("binary"), 256) == per["key"], "left").select("doc_id", "text", "hits", "items")
        found = rows.mapInArrow(_report(lambda text, batch, i: (batch.column(2)[i].as_py() or [], sorted({*(batch.column(3)[i].as_py() or ())}))), _schema(docs))
    return found.withColumn("items", F.col("items").cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"))


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<array<int>>"


def _clean(patterns, at: int):
    """The rows of whole batches without a match in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(patterns)
        for batch in batches:
            yield batch.filter(pa.array([not m.scan(b" " + b" ".join(words_of(t)) + b" ") for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def _matches(patterns):
    """key, hits, items of the texts with a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(patterns)
        for batch in batches:
            rows = [(hashlib.sha256(t.encode()).hexdigest(), *_found(m, t)) for t in batch.column(0).to_pylist()]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())))], names=["key", "hits", "items"])

    return run


def _report(found):
    """The report of rows whose matches ``found(text, batch, row)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits, ids = found(text, batch, i)
                n_words.append(len(words_of(text)))
                items.append(ids)
                merged: list[list[int]] = []
                for a, b in sorted(zip(hits[::2], hits[1::2])):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                n_hit.append(sum(b - a + 1 for a, b in merged))
                spans.append([list(x) for x in _original_offsets(text, *zip(*merged))] if merged else [])
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
