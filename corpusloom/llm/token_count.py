"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the space mark before it.  Distinct pre-tokens are inserted in a trie.  A node is a prefix: when
it is made, its best score and the number of pieces that reach it are computed once, from the nodes above it that a
vocabulary piece links to it, however many pre-tokens share it later; a terminal node stores its pre-token's count.  The
pieces that end at a node are found in a second trie, of the vocabulary's pieces from their ends.  A worker keeps its trie
until it has ``generation`` nodes, and the counts of the one before, so memory is bounded.

The model is a public vocabulary; tokenizers are not trained here, so piece scores follow from the ranks (see
``vocabulary``).  Characters without a piece cost ``unknown`` each and one token each.  Between segmentations of equal score
the one with fewer tokens is counted.

Defined results: null and empty texts have no tokens; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import small_batches, table, worker_cache

SPACE = "▁"


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Piece scores of a public vocabulary: the logarithm of a Zipf law over its ranks."""
    import math

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    kept = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (r + 10) for r in range(len(kept))))
    return {sp.id_to_piece(i): -math.log(r + 10) - norm for r, i in enumerate(kept)}


class TrieCounter:
    """Forward scores over the trie of the pre-tokens given so far."""

    def __init__(self, scores: dict[str, float], unknown: float = -20.0, generation: int = 600_000):
        self.unknown, self.generation = unknown, generation
        #: nodes of the pieces read from their ends: character -> node; the key None holds a piece's score
        self.ends: dict = {}
        for piece, s in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = s
        #: counts stored at the terminal nodes of this trie and of the one before it
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.nodes, self.root = 0, {}

    def learn(self, pre_tokens, lead: str = "") -> None:
        """Insert pre-tokens, each behind ``lead``; ``known`` has their counts, without it."""
        unknown, ends, known, made = self.unknown, self.ends, self.known, 0
        for name in pre_tokens:
            word, node, path = lead + name, self.root, [(0.0, 0)]
            for end, c in enumerate(word):
                down = node.get(c)
                if down is None:  # a new prefix: its score from those above it
                    best, count = path[end][0] + unknown, path[end][1] + 1
                    piece, start = ends, end
                    while start >= 0 and (piece := piece.get(word[start])) is not None:
                        if (s := piece.get(None)) is not None:
                            before = path[start]
                            s += before[0]
                            if s > best or (s == best and before[1] + 1 < count):
                                best, count = s, before[1] + 1
                        start -= 1
                    down = node[c] = {None: (best, count)}
                    made += 1
                path.append(down[None])
                node = down
            known[name] = path[-1][1]
        self.nodes += made

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if self.nodes > self.generation:
            self.old, self.known = self.known, {}
            self._clear()
        words = [[w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").split()] for t in texts]
        seen: set[str] = set()
        for ws in words:
            seen.update(ws)
        fresh = seen.difference(self.known)
        for w in fresh.intersection(self.old):
            self.known[w] = self.old[w]
        self.learn(fresh.difference(self.old), SPACE)
        get = self.known.__getitem__
        return [(len(ws), sum(map(get, ws))) for ws in words]


def token_counts(docs: DataFrame, path: str | None = None, step: int = 1024) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache("tokens", str(path), lambda: TrieCounter(vocabulary(path)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=["doc_id", "n_pretokens", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
