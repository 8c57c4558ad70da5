"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon maps a word to a symbol: insult (with a weight), threat, target, negation or report; every other word maps to
``other``.  Five small transducers read the symbols of a clause: insult (passes an insult's weight on), threat (a threat
verb is one only with a target), target (raises insults after it), negation (damps what follows it for three words) and
reported speech (damps the rest of the clause, and what a colon after it opens).  A pass from the right first marks the
threat verbs that a target follows in the clause, so that 'kill you' counts as 'dich töten' does.
They are composed into one transducer whose states are nested pairs; a clause's weight is the sum of what its path emits, and
a document's score is a logistic function of its clauses' weights.  Only clauses with an insult or a threat emit, so
others need not be read: an Aho-Corasick automaton over the stems finds them in one pass over the text.

Insult stems are learned from labelled rows: word prefixes and whole words that label 1 has and label 0 lacks; a short
list of general insults is the prior.  At most ``max_rows`` labelled ids are used, those with the least hash, and one text
of each (the least by hash); an id labelled more than once counts as toxic if one of its labels is 1.  Near copies among
them share the weight of one.

Defined results: null and empty texts and texts without a matched clause get the score of weight 0; repeated rows give
repeated rows; without labels of both kinds the prior alone decides; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, small_batches, table

# Word lists of the grammar (English, German, French, Spanish).
INSULTS = "idiot stupid moron trash clown loser scum pathetic worthless disgusting dumb imbecile dummkopf arschloch trottel abschaum connard ordure imbécile estúpido imbécil basura"
THREATS = "kill hurt destroy murder shoot burn strangle töten umbringen vernichten tuer détruire frapper matar destruir"
TARGETS = "you your yours u he she they him them her these those people du dich dir ihr euch dein tu toi te vous ils elles tú ti vosotros ellos ustedes"
NEGATIONS = "not never no neither nor cannot isn't aren't don't won't nicht nie kein keine pas jamais aucun nunca jamás ningún"
REPORTS = "said says say wrote writes called quoted claimed told reported allegedly sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED = SYMBOLS = range(7)
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """Arcs ``(state, symbol) -> (next state, factor, bonus)``; an emitting symbol yields ``factor * weight + bonus``."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols in step; factors multiply and bonuses add."""
        mine, theirs = {s for s, _ in self.arcs}, {s for s, _ in other.arcs}
        arcs = {}
        for a, b, y in product(mine, theirs, SYMBOLS):
            (na, fa, ba), (nb, fb, bb) = self.arcs[a, y], other.arcs[b, y]
            arcs[(a, b), y] = ((na, nb), fa * fb, ba * fb + bb * fa)
        return Transducer((self.start, other.start), arcs)

    def weight(self, symbols: list[tuple[int, float]], start=None) -> float:
        state, total = self.start if start is None else start, 0.0
        for y, w in symbols:
            state, factor, bonus = self.arcs[state, y]
            if w:
                total += factor * w + bonus
        return total


def _negation(span: int = 3, damp: float = 0.5) -> Transducer:
    arcs = {}
    for k, y in product(range(span + 1), SYMBOLS):
        arcs[k, y] = (span if y == NEGATION else max(0, k - 1), damp if k else 1.0, 0.0)
    return Transducer(0, arcs)


def _report(damp: float = 0.6) -> Transducer:
    return Transducer(0, {(k, y): (1 if y == REPORT else k, damp if k else 1.0, 0.0) for k, y in product((0, 1), SYMBOLS)})


def _insult() -> Transducer:
    return Transducer(0, {(0, y): (0, 1.0, 0.0) for y in SYMBOLS})


def _threat(bonus: float = 0.5) -> Transducer:
    """State 1 after a target.  A threat verb counts only with a target before it or, if aimed, after it."""
    arcs = {}
    for k, y in product((0, 1), SYMBOLS):
        arcs[k, y] = (1 if y == TARGET else k, 0.0 if y == THREAT and not k else 1.0, bonus if y == AIMED or (k and y == THREAT) else 0.0)
    return Transducer(0, arcs)


def _target(raise_by: float = 1.3) -> Transducer:
    """State 1 after a target, where insults weigh more."""
    return Transducer(0, {(k, y): (1 if y == TARGET else k, raise_by if k and y == INSULT else 1.0, 0.0) for k, y in product((0, 1), SYMBOLS)})


GRAMMAR = _insult().compose(_threat()).compose(_target()).compose(_negation()).compose(_report())
REPORTED = (GRAMMAR.start[0], 1)  # the state of a clause that a colon sets off from reported speech


def aim(symbols: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The symbols of a clause, read from the right: threat verbs that a target follows are aimed."""
    out, target = [], False
    for y, w in reversed(symbols):
        target |= y == TARGET
        out.append((AIMED if target and y == THREAT else y, w))
    return out[::-1]


class Lexicon:
    """Word to (symbol, weight): whole words, and stems that a word may begin with."""

    def __init__(self, stems: dict[str, float], words: dict[str, float]):
        self.stems, self.words = dict(stems), dict(words)
        self.shortest = min(map(len, self.stems), default=0)
        self.fixed = {w: y for y, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}

    def symbol(self, word: str) -> tuple[int, float]:
        if (w := self.words.get(word)) is not None:
            return INSULT, w
        if self.stems:
            for n in range(min(len(word) - 1, 8), self.shortest - 1, -1):
                if (w := self.stems.get(word[:n])) is not None:
                    return INSULT, w
        y = self.fixed.get(word, OTHER)
        return y, (0.5 if y == THREAT else 0.0)


class Scorer:
    def __init__(self, lexicon: Lexicon, coef: tuple[float, float, float] = (2.5, 1.0, -2.0)):
        self.lexicon, self.coef, self._automaton = lexicon, coef, None

    def __getstate__(self):
        return self.lexicon, self.coef

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            shortest = {s for s in self.lexicon.stems if not any(s[:n] in self.lexicon.stems for n in range(3, len(s)))}
            for s in {*shortest, *self.lexicon.words, *THREATS.split()}:
                self._automaton.add_word(s, len(s))
            self._automaton.make_automaton()
        return self._automaton

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matched clauses, in characters of the lower-cased text."""
        low, out, done = (text or "").lower(), [], 0
        told, read = False, 0  # whether speech is reported where reading for it stopped
        for last, n in self.automaton.iter(low) if low else ():
            at = last - n + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            start = max(low.rfind(c, done, at) for c in ".!?;:\n") + 1 or done
            end = m.start() if (m := _CLAUSE_END.search(low, last)) else len(low)
            if colon := start > 0 and low[start - 1] == ":":
                sentence = max(low.rfind(c, read, start) for c in ".!?;\n") + 1
                told = (told and not sentence) or any(self.lexicon.fixed.get(x) == REPORT for x in _WORD.findall(low, sentence or read, start))
                read = start
            w = GRAMMAR.weight(aim([self.lexicon.symbol(x) for x in _WORD.findall(low, start, end)]), REPORTED if colon and told else None)
            if w > 0:
                out.append((start, end, w))
            done = end
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        weights = [w for _, _, w in self.clauses(text)]
        return math.log1p(sum(weights)), max(weights, default=0.0)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.coef[0] * a + self.coef[1] * b + self.coef[2]))))


def _stems_of(text: str) -> set[str]:
    """Features of a text: its words, and ``stem*`` for stems of three to eight letters of longer words."""
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 2}
    return words.union(f"{w[:n]}*" for w in words for n in range(3, 9) if len(w) > n)


def copy_weights(texts: list[str]) -> list[float]:
    """A weight for each text: texts whose two least hashes of three-word shingles agree share that of one."""
    keys = []
    for t in texts:
        words = re.findall(r"[^\W\d_]+", t.lower())
        hashes = [zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))]
        keys.append((min(hashes), min(h * 2654435761 % (1 << 32) for h in hashes)))
    alike = Counter(keys)
    return [1 / alike[k] for k in keys]


def learn_lexicon(texts: list[str], labels: list[int]) -> Lexicon:
    """Stems and words that are frequent under label 1 and all but absent under label 0; near copies share a weight."""
    prior = {w: 1.0 for w in INSULTS.split()}
    rows = list(zip(texts, labels, copy_weights(texts)))
    n_pos, n_neg = (sum(w for _, y, w in rows if bool(y) == kind) for kind in (True, False))
    if not n_pos or not n_neg:
        return Lexicon({}, prior)
    least = 3 if n_pos < 100 else 5 if n_pos < 500 else 8

    def count(kind: bool, fits) -> Counter:
        out: Counter = Counter()
        for t, y, w in rows:
            if bool(y) == kind:
                for f in filter(fits, _stems_of(t)):
                    out[f] += w
        return out

    had = count(True, None)
    common = {f for f, n in had.items() if n >= least - 1e-9}
    lacks = count(False, common.__contains__)

    def odds(f: str) -> float:
        return math.log((had[f] + 0.5) / (n_pos + 1)) - math.log((lacks[f] + 0.5) / (n_neg + 1))

    words = {f: odds(f) for f in common if f[-1] != "*" and odds(f) >= 3}
    roots: set[str] = set()
    for f in sorted((f for f in common if f[-1] == "*" and had[f] >= 2 * least - 1e-9), key=lambda f: (len(f), f)):
        if odds(f) >= 2.3 and not any(f[:n] in roots for n in range(3, len(f) - 1)):
            roots.add(f[:-1])
    # below a root every stem and word seen often enough has odds of its own; the longest that fits a word counts
    inside = re.compile("|".join(sorted(roots)) or r"(?!)")
    had, lacks = count(True, inside.match), count(False, inside.match)
    below = {f: odds(f) for f in {*had, *lacks} if had[f] + lacks[f] >= 3 - 1e-9}
    # a stem as frequent as a longer stem or word that begins with it says no more than that one
    seen = lambda f: (round(had[f], 6), round(lacks[f], 6))
    same = {(f.rstrip("*")[:n], *seen(f)) for f in below for n in range(3, len(f.rstrip("*")))}
    below = {f: x for f, x in below.items() if f[-1] != "*" or (f[:-1], *seen(f)) not in same}
    words |= {f: x for f, x in below.items() if f[-1] != "*"}
    stems = {f[:-1]: max(0.0, min(1.5, x / 4)) for f, x in below.items() if f[-1] == "*"}
    return Lexicon(stems, {w: 1.3 for w in INSULTS.split()} | {f: max(0.0, min(1.5, x / 4)) for f, x in words.items()})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression with an intercept (last)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Scorer:
    """Lexicon and logistic coefficients from at most ``max_rows`` labelled ids (label not null, held-out rows left out)."""
    known = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts, y = [r["text"] for r in rows], np.array([r["toxic"] for r in rows], float)
    scorer = Scorer(learn_lexicon(texts, y.tolist()))
    if 0 < y.sum() < len(y):
        a, b, c = _logistic(np.array([scorer.features(t) for t in texts]), y)
        scorer.coef = (float(a), float(b), float(c))
    return scorer


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, clauses: also the matched clauses as (start, end, weight)."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(scorer)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = known.value
        for batch in batches:
            score, found = [], []
            for text in batch.column(1).to_pylist():
                hits = s.clauses(text)
                a, b = math.log1p(sum(h[2] for h in hits)), max((h[2] for h in hits), default=0.0)
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s.coef[0] * a + s.coef[1] * b + s.coef[2])))))
                found.append([dict(zip(("start", "end", "weight"), h)) for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(found, span)], names=["doc_id", "score", "clauses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, clauses array<struct<start:int,end:int,weight:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))
