"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on the document id.

``write_token_ids`` tokenises whole texts and writes one ORC file per range of document ids, in ascending order.
``read_token_ids`` reads them back by stripes in parallel; a filter on ``doc_id`` prunes files, stripes and row groups
by their statistics and Bloom filters.  ``token_digest`` derives offsets and checksums from the files.

Defined results: null and empty texts become the end id alone; a null ``doc_id`` sorts first; rows that repeat a
``doc_id`` are all kept, ordered by text; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives
files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import release_memory, saved, scratch_dir, small_batches, table, worker_cache

_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: letters that every Unicode version knows; marks behind them are a pre-token of their own
_LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{410}-\x{44F}]+"
#: white space but single spaces and line feeds, and special tokens
_UNFIT = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"


def _large(*texts: str) -> list[pa.Scalar]:
    return [pa.scalar(t, pa.large_string()) for t in texts]


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, …`` (``count`` of them) of all ranges in a row."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


class PieceEncoder:
    """Byte-level BPE by pieces between spaces.

    The pre-tokenizer of byte-level vocabularies never joins characters across ``non-space, space``, so the ids of a
    text are those of its pieces in order.  A piece is what follows a space, or a line feed and what follows it; a text
    starts as if behind a line feed.  Arrow splits a slice of texts and numbers its distinct pieces; those not met
    before go through the tokenizers library together, and the ids of the pieces are laid out by gathers, a part of the
    slice at a time.  A worker keeps the pieces used last.  Texts with runs of white space, other white space than single spaces and line feeds,
    or special tokens go through the tokenizer whole.
    """

    def __init__(self, path: str, generation: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core; threads would keep memory of their own
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.generation = generation
        self.newline = self._ids("\n")
        self._forget()

    def _forget(self) -> None:
        #: the pieces; where their ids start in ``ids``, how many they are (-1: the text goes whole); the slice that used them last
        self.words = pa.array([], pa.large_string())
        self.start, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids, self.marks, self.slices = np.zeros(0, np.int32), {}, 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _store(self, ids: np.ndarray) -> int:
        at = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        return at

    def _add(self, words: pa.Array, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.full(len(words), self.slices)])
        return np.arange(at, len(self.words))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Pieces without white space, behind a space or with their line feed, through the tokenizer in long texts."""
        feed = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        lines = pc.if_else(pa.array(feed), words, pc.binary_join_element_wise(*_large("\n "), words, *_large(""))).to_pylist()
        texts = ["".join(lines[at : at + 500]) for at in range(0, len(lines), 500)]
        rows = [np.array(e.ids, np.int32) for at in range(0, len(texts), 16) for e in self.tok.encode_batch_fast(texts[at : at + 16], add_special_tokens=False)]
        ids = np.concatenate([*rows, np.zeros(0, np.int32)])
        feeds = np.flatnonzero(ids == self.newline[0])
        begin = feeds + ~feed  # a piece with a line feed has its id as well
        return self._add(words, self._store(ids) + begin, np.append(feeds[1:], len(ids))[: len(feed)] - begin)

    def _known(self, words: pa.Array) -> np.ndarray:
        """The rows of these distinct pieces, -1 for those not met before.  Theirs is the table of hashes, as they are fewer."""
        place, rows = pc.index_in(self.words, value_set=words), np.full(len(words), -1)
        rows[place.drop_null().to_numpy()] = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        return rows

    def _meet(self, new: pa.Array) -> np.ndarray:
        """The rows of pieces not met before; letters before ASCII marks are two pre-tokens: their ids are joined from both."""
        body, base = pc.utf8_ltrim(new, "\n"), pc.utf8_rtrim(new, _MARKS)
        unfit = pc.or_(pc.equal(body, ""), pc.match_substring_regex(body, _UNFIT))
        joined = pc.and_not(pc.and_(pc.not_equal(base, new), pc.match_substring_regex(base, f"^\n?{_LETTERS}$")), unfit)
        base, plain = base.filter(joined), pc.invert(pc.or_(unfit, joined))
        fresh = pa.concat_arrays([new.filter(plain), base]).unique()
        row_of = self._known(fresh)
        row_of[row_of < 0] = self._learn(fresh.filter(pa.array(row_of < 0)))
        rows = np.zeros(len(new), np.int64)
        rows[plain.to_numpy(zero_copy_only=False)] = row_of[: pc.sum(plain).as_py()]  # they lead ``fresh``
        bad = new.filter(unfit)
        rows[unfit.to_numpy(zero_copy_only=False)] = self._add(bad, np.zeros(len(bad), np.int64), np.full(len(bad), -1))
        if len(base):
            both = new.filter(joined)
            tails = pc.replace_substring_regex(both, f"^\n?{_LETTERS}", "").dictionary_encode()
            for t in tails.dictionary.to_pylist():
                if t not in self.marks:
                    ids = self._ids(t)
                    self.marks[t] = (self._store(ids), len(ids))
            tail = np.array([self.marks[t] for t in tails.dictionary.to_pylist()])[tails.indices.to_numpy()]
            at = row_of[pc.index_in(base, value_set=fresh).to_numpy()]
            start, count = np.column_stack([self.start[at], tail[:, 0]]), np.column_stack([self.count[at], tail[:, 1]])
            total = count.sum(axis=1)
            first = self._store(self.ids[_gather(start.ravel(), count.ravel())])
            rows[joined.to_numpy(zero_copy_only=False)] = self._add(both, first + np.cumsum(total) - total, total)
        return rows

    def _keep_recent(self) -> None:
        """Beyond two generations, the pieces that were used last stay."""
        if len(self.words) <= 2 * self.generation:
            return
        kept = np.sort(np.argsort(self.used, kind="stable")[-self.generation :])
        count = np.maximum(self.count[kept], 0)
        ids = self.ids[_gather(self.start[kept], count)]
        start = np.cumsum(count) - count
        self.words, self.start, self.count, self.used = self.words.take(pa.array(kept)), start, self.count[kept], self.used[kept]
        self.ids, self.marks = ids, {}

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the row of each piece of all texts, where each text's begin and the last one's end)."""
        lists = pc.split_pattern(pc.binary_join_element_wise(*_large("\n"), pc.replace_substring(texts, "\n", " \n"), *_large("")), " ")
        heads = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        del lists
        rows = self._known(pieces.dictionary)
        if rows.min() < 0:
            rows[rows < 0] = self._meet(pieces.dictionary.filter(pa.array(rows < 0)))
        self.used[rows] = self.slices
        return rows.astype(np.int32)[pieces.indices.to_numpy()], heads - heads[0]

    def _part(self, texts: pa.Array, at: np.ndarray, heads: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        start, count = self.start[at], self.count[at]
        start[heads] += 1  # the line feed before a text is none of its own
        whole = np.flatnonzero(np.minimum.reduceat(count, heads) < 0)
        count[heads] -= 1
        pool = self.ids
        if len(whole):
            found = self.tok.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
            ids, offsets = self._lay([np.array(e.ids, np.int32) for e in found])
            inside = np.repeat(np.isin(np.arange(len(heads)), whole), np.diff(np.append(heads, len(count))))
            count[inside] = 0
            start[heads[whole]], count[heads[whole]] = len(pool) + offsets[:-1], np.diff(offsets)
            pool = np.concatenate([pool, ids])
        if end is not None:
            stops = np.append(heads[1:], len(count))
            start, count = np.insert(start, stops, len(pool)), np.insert(count, stops, 1)
            heads, pool = heads + np.arange(len(heads)), np.append(pool, np.int32(end))
        return pool[_gather(start, count)], np.concatenate([[0], np.cumsum(np.add.reduceat(count, heads))])

    def encode_parts(self, texts: pa.Array, end: int | None = None, pieces: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, their ids in a row, offsets), for texts of about so many pieces at a time, in order; ``end``, if
        given, follows each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        if len(self.newline) != 1:  # a vocabulary without a lone line feed
            yield len(texts), *self._lay([np.append(self._ids(t), [] if end is None else end) for t in texts.to_pylist()])
            return
        self._keep_recent()
        self.slices += 1
        at, heads = self._rows(texts)
        cuts = np.flatnonzero(np.diff(heads[:-1] // pieces)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            yield b - a, *self._part(texts.slice(a, b - a), at[heads[a] : heads[b]], heads[a:b] - heads[a], end)

    @staticmethod
    def _lay(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32), np.cumsum([0, *map(len, rows)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        parts = self.encode_parts(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<i4").tobytes() for _, ids, at in parts for a, b in zip(at[:-1], at[1:])]


def _encoder(path: str) -> PieceEncoder:
    return worker_cache("pieces", path, lambda: PieceEncoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids: the ids of each text and the end id.  Texts are split in slices of about ``slice_bytes`` and their ids
    laid out in smaller parts, so a worker holds little beside the pieces it keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for batch in batches:
            before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(before // slice_bytes)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                for n, ids, offsets in enc.encode_parts(batch.column(1).slice(a, b - a), end_id):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])
                    a += n
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, row_index_stride: int = 2_000, stripe_mb: int = 64) -> str:
    """Write ``seq, doc_id, ids`` as ORC in ascending ``doc_id`` order and return ``path``.

    ``seq`` is the partition number times 2**33 plus the row number in it, so it ascends with ``doc_id`` over all files.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ids = token_ids(ordered, tokenizer_path or default_tokenizer(), end_id)
    (
        ids.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids")
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )
    return path


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``seq, doc_id, ids`` of the files; filters on ``doc_id`` are pushed to the ORC reader."""
    return spark.read.schema("seq long, doc_id long, ids array<int>").orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["seq", "doc_id", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files' rows; ``start`` counts the ids of all rows before.

    Two-step prefix sum: a window inside each file's rows, and one over the files' totals (a row per file).
    """
    rows = saved(read_token_ids(spark, path).mapInArrow(_checksums, "seq long, doc_id long, n_tokens long, ids_crc32 long"), "token-digest")
    rows = rows.withColumn("part", F.shiftright("seq", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_ids(table(spark, sf_dir, "documents"), scratch_dir(spark, "token-ids"))
    return token_digest(spark, path)
