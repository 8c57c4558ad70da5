"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are its affixes and inner n-grams of one to four letters (a word is bounded by marks, so affixes are
the n-grams that hold a mark) and the word itself as a lexicon entry, all hashed; label transitions are learned.
Posteriors of every word come from forward-backward over the whole text, in segments that are read in step; a document's language has the largest mean
posterior, which is its score.

Training takes at most ``per_language`` whole documents of each language, those with the least hash of their id, cuts
them into runs of words and joins runs of different languages, so that transitions are learned from known switches.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the first language by code
point; without labelled rows everything is ``und``; repeated rows give repeated rows; extra columns are ignored by
``identify`` and carried by ``keep_identified``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.chain import fit_sparse, flat_marginals
from corpusloom.llm.common import crc_mod, drop_worker_cache, release_memory, small_batches, table

BUCKETS = 1 << 17
_LONGEST = 24  # longer runs of letters are read as several words
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_RUNS = re.compile(rf"[^\W\d_]{{1,{_LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) of a text in lower case; runs of over ``_LONGEST`` in pieces."""
    found = _RUNS.findall((text or "").lower())
    if found and not "".join(found).isalpha():  # other numbers, such as ², are word characters too
        found = [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]
    return found


def word_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word as (features, mask), both (words, slots)."""
    width = max(map(len, words)) + 2
    codes = np.zeros((len(words), width), np.uint64)
    size = np.array([len(w) for w in words]) + 2
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(words)), size - 2)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2) + 1
    codes[rows, cols] = flat
    codes[:, 0] = 2
    codes[np.arange(len(words)), size - 1] = 3
    feats, mask, acc = [], [], np.zeros_like(codes)
    whole = np.zeros(len(words), np.uint64)
    for j in range(width):
        whole = np.where(j < size, (whole * _M1 + codes[:, j] + np.uint64(7)) * _M2, whole)  # as long as the word, not the longest beside it
    whole ^= whole >> np.uint64(31)
    for n in range(1, 5):
        if n > width:
            break
        acc = (acc[:, : width - n + 1] * _M1 + codes[:, n - 1 :] + np.uint64(n)) * _M2
        h = acc ^ (acc >> np.uint64(29))
        feats.append((h % np.uint64(buckets)).astype(np.int32))
        mask.append(np.arange(width - n + 1)[None, :] + n <= size[:, None])
    feats.append((whole % np.uint64(buckets)).astype(np.int32)[:, None])
    mask.append(np.ones((len(words), 1), bool))
    return np.concatenate(feats, axis=1), np.concatenate(mask, axis=1)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.languages, self.trans, self.start = languages, trans, start
        self.weights = weights.astype(np.float32)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: list[str]) -> None:
        """Emission scores of words not met before."""
        words.sort(key=len)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            feats, mask = word_features(part, len(self.weights))
            at = len(self.rows)
            if at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for y in range(len(self.languages)):
                self.table[at : at + len(part), y] = (self.weights[:, y][feats] * mask).sum(axis=1)
            self.rows.update(zip(part, range(at, at + len(part))))

    def posteriors(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(label posteriors of all words in a row, words of each document)."""
        if len(self.rows) > 300_000:
            self.rows, self.table = {}, np.zeros((1 << 16, len(self.languages)), np.float32)
        seen: set[str] = set()
        for d in docs:
            seen.update(d)
        self._learn(list(seen.difference(self.rows)))
        lengths = np.array([len(d) for d in docs], np.int64)
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
        return flat_marginals(self.table[at].astype(np.float64), lengths, self.trans, self.start), lengths

    def known(self, docs: list[list[str]], least: float, words: int) -> np.ndarray:
        """Whether documents have words, and (from ``words`` on) words that are of one of the languages each: the mean of
        every word's largest posterior is ``least`` at least.  Code-switched words are certain, too, each in its language."""
        post, lengths = self.posteriors(docs)
        certain, some = np.ones(len(docs)), np.flatnonzero(lengths)
        if len(some):
            certain[some] = np.add.reduceat(post.max(axis=1), (np.cumsum(lengths) - lengths)[some]) / lengths[some]
        return (lengths > 0) & ((lengths < words) | (certain >= least))

    def label(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(label, mean posterior of it, words, words of another label) of each document; no words: label -1."""
        post, lengths = self.posteriors(docs)
        label, score, switched = np.full(len(docs), -1), np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        some = np.flatnonzero(lengths)
        if len(some):
            heads = (np.cumsum(lengths) - lengths)[some]
            mean = np.add.reduceat(post, heads) / lengths[some][:, None]
            label[some] = mean.argmax(axis=1)
            score[some] = np.minimum(1.0, mean.max(axis=1))
            other = post.argmax(axis=1) != np.repeat(label[some], lengths[some])
            switched[some] = np.add.reduceat(other.astype(np.int64), heads)
        return label, score, lengths, switched


def training_rows(docs: DataFrame, per_language: int, salts: int = 64) -> list:
    """At most ``per_language`` labelled texts of each language, those with the least hash of their id.

    Hashes are picked first, by language and salt and then by language; texts are read for the picked ones alone.  Rows
    that repeat an id and its text are one.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2) & F.col("text").isNotNull())
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", F.lit("langid")).alias("h"), F.xxhash64("text").alias("t"))
    first = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "t"))).where(F.col("r") <= per_language)
    picked = first(first(labelled.select("lang", "h", "t", F.pmod("t", F.lit(salts)).alias("salt")).distinct(), "lang", "salt").drop("r"), "lang").select("lang", "h", "t")
    rows = labelled.join(F.broadcast(picked), ["lang", "h", "t"], "left_semi").dropDuplicates(["lang", "h", "t"])  # as many as are asked for
    return rows.orderBy("lang", "h", "t").select("lang", "text").collect()


def fit(docs: DataFrame, per_language: int = 250, buckets: int = BUCKETS, seed: int = 5) -> Model | None:
    """A model from the whole texts of at most ``per_language`` documents of each language."""
    rows = training_rows(docs, per_language)
    languages = sorted({r["lang"] for r in rows})
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, list[str]]] = []
    for r in rows:
        words = words_of(r["text"])
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 40))
            runs.append((languages.index(r["lang"]), words[at : at + n]))
            at += n
    if not runs:
        return None
    known = sorted({w for _, ws in runs for w in ws}, key=lambda w: (len(w), w))
    feats: dict[str, np.ndarray] = {}
    for i in range(0, len(known), 4096):
        part = known[i : i + 4096]
        f, m = word_features(part, buckets)
        feats.update((w, f[k][m[k]]) for k, w in enumerate(part))
    seqs, order, at = [], rng.permutation(len(runs)), 0
    while at < len(order):
        n = int(rng.choice([1, 2, 3], p=[0.5, 0.3, 0.2]))
        part = [runs[i] for i in order[at : at + n]]
        at += n
        per = [feats[w] for _, ws in part for w in ws]
        labels = np.concatenate([np.full(len(ws), y) for y, ws in part]).astype(int)
        if len(per):
            seqs.append((np.concatenate(per), np.cumsum([0, *map(len, per)]), labels))
    w, trans, start = fit_sparse(seqs, buckets, len(languages), epochs=2, batch=64)
    return Model(languages, w, trans, start)


def identify(docs: DataFrame, model: Model | None, step: int = 256) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switched: also how many words carry another label than the document's."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        m = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                none = np.zeros(len(words), np.int64)
                label, score, n, switched = m.label(words) if m else (none - 1, none, np.array([len(w) for w in words]), none)
                lang = [m.languages[y] if y >= 0 else "und" for y in label.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switched, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words", "n_switched"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_words long, n_switched long")


def keep_identified(docs: DataFrame, model: Model | None, step: int = 256, least: float = 0.6, words: int = 20) -> DataFrame:
    """The rows of ``docs`` but those without a language: null texts, texts without letters, and texts of ``words`` words
    and more whose words are of no learned language (mean certainty under ``least``; fewer words say too little, and without
    a model nothing is)."""
    small_batches(docs.sparkSession)
    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        m = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = [words_of(t) for t in part.column(at).to_pylist()]
                kept = m.known(found, least, words) if m else [bool(w) for w in found]
                yield part.filter(pa.array(kept, pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switched")
