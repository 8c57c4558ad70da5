"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

Patterns find the base spans (e-mail, IPv4 address, payment card, international phone number).  The network, trained in
numpy from labelled spans, reads windows of characters around every digit and ``@`` of the text (no kind has neither),
so whole texts are covered however long.  Emission scores of overlapping windows are averaged, weighted by the distance
to the window's edge, and each run of windows is decoded as one sequence, so a span that crosses windows is found once.
Decoded spans that touch no base span, are well formed for their kind and have a mean posterior of ``sure`` are added.

Training spans come from ``training_windows``: invented prose with inserted data in many formats, and numbers that are
not personal (prices, dates, versions, order numbers).  Check digits are not learned but tested afterwards.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows give repeated
rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.chain import marginals, viterbi
from corpusloom.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GATE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and non-overlapping per kind; matches that fail their check are dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # an e-mail starts as far left of its @ as its characters reach, but not in the one before
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if _GATE.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the network --------------------------------------------------------------------------------------------------

WINDOW, STRIDE, MARGIN = 96, 64, 40
LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_PUNCT = "@.+-() /,:;_%#[]<>\"'=\n"
_CLASSES = 32 + len(_PUNCT)


def char_classes(codes: np.ndarray) -> np.ndarray:
    """0 padding, 1 other, 2 digit, 3 other letter, 4 capital, 5.. a-z, then some punctuation."""
    out = np.ones(len(codes), np.int64)
    out[(codes >= 48) & (codes <= 57)] = 2
    out[codes >= 0xC0] = 3
    out[(codes >= 65) & (codes <= 90)] = 4
    small = (codes >= 97) & (codes <= 122)
    out[small] = codes[small] - 97 + 5
    for k, c in enumerate(_PUNCT):
        out[codes == ord(c)] = 31 + k
    return out


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of the outer products of the last axes."""
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


class Net:
    def __init__(self, hidden: int = 32, dim: int = 16, seed: int = 31):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "e": rng.standard_normal((_CLASSES, dim)) * 0.3,
            "wx": rng.standard_normal((2, dim, 4 * hidden)) / np.sqrt(dim),
            "wh": rng.standard_normal((2, hidden, 4 * hidden)) / np.sqrt(hidden) * 0.7,
            "b": np.zeros((2, 1, 4 * hidden)),
            "wo": rng.standard_normal((2 * hidden, LABELS)) / np.sqrt(2 * hidden),
            "bo": np.zeros(LABELS),
            "trans": np.zeros((LABELS, LABELS)),
            "start": np.zeros(LABELS),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0
        for inside in range(2, LABELS, 2):  # the inside of a kind follows its begin or inside
            self.p["trans"][[y for y in range(LABELS) if y not in (inside - 1, inside)], inside] = self.p["start"][inside] = -8.0
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def forward(self, ids: np.ndarray, keep: bool = False):
        """Emission scores (steps, rows, labels) of windows (rows, steps); both directions run as one stack."""
        p, h = self.p, self.h
        x = p["e"][ids.T]
        xs = np.stack([x, x[::-1]])
        pre = (xs @ p["wx"][:, None] + p["b"][:, None]).transpose(1, 0, 2, 3)
        steps, rows = ids.shape[1], ids.shape[0]
        hs, cs = np.zeros((steps + 1, 2, rows, h), np.float32), np.zeros((steps + 1, 2, rows, h), np.float32)
        gates = np.empty((steps, 2, rows, 4 * h), np.float32)
        for t in range(steps):
            z = pre[t] + hs[t] @ p["wh"]
            z[..., : 3 * h] = 1 / (1 + np.exp(-z[..., : 3 * h]))
            z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            cs[t + 1] = z[..., h : 2 * h] * cs[t] + z[..., :h] * z[..., 3 * h :]
            hs[t + 1] = z[..., 2 * h : 3 * h] * np.tanh(cs[t + 1])
            gates[t] = z
        both = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], axis=2)
        scores = both @ p["wo"] + p["bo"]
        return (scores, (xs, hs, cs, gates, both)) if keep else scores

    def backward(self, ids: np.ndarray, ds: np.ndarray, memory) -> dict[str, np.ndarray]:
        p, h = self.p, self.h
        xs, hs, cs, gates, both = memory
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["wo"], g["bo"] = _outer(both, ds), ds.sum(axis=(0, 1))
        dboth = ds @ p["wo"].T
        dh_out = np.stack([dboth[..., :h], dboth[::-1][..., h:]], axis=1)
        dz_all = np.empty_like(gates)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        for t in range(len(gates) - 1, -1, -1):
            i, f, o, c = (gates[t][..., k * h : (k + 1) * h] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[..., :h] = dc * c * i * (1 - i)
            dz[..., h : 2 * h] = dc * cs[t] * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - c * c)
            dc = dc * f
            dh = dz @ p["wh"].transpose(0, 2, 1)
        g["wh"] = np.stack([_outer(hs[:-1, k], dz_all[:, k]) for k in (0, 1)])
        g["wx"] = np.stack([_outer(xs[k], dz_all[:, k]) for k in (0, 1)])
        g["b"] = dz_all.sum(axis=(0, 2))[:, None, :]
        dx = [dz_all[:, k] @ p["wx"][k].T for k in (0, 1)]
        seen = np.zeros((ids.size, _CLASSES), np.float32)
        seen[np.arange(ids.size), ids.T.ravel()] = 1
        g["e"] = seen.T @ (dx[0] + dx[1][::-1]).reshape(ids.size, -1)
        return g

    def train(self, ids: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the chain's negative log likelihood."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        lengths = lambda n: np.full(n, ids.shape[1])
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                x, y = ids[pick], labels[pick].T
                scores, memory = self.forward(x, keep=True)
                post, _, pairs = marginals(scores, lengths(len(pick)), self.p["trans"], self.p["start"], want_pairs=True)
                post[np.arange(len(y))[:, None], np.arange(y.shape[1])[None, :], y] -= 1
                g = self.backward(x, (post / len(pick)).astype(np.float32), memory)
                seen = np.zeros_like(pairs)
                np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
                g["trans"], g["start"] = (pairs - seen) / len(pick), post[0].sum(axis=0) / len(pick)
                norm = np.sqrt(sum(float((x_ * x_).sum()) for x_ in g.values()))
                step += 1
                for k, x_ in g.items():
                    x_ = (x_ * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * x_
                    v[k] = 0.999 * v[k] + 0.001 * x_ * x_
                    lr = rate * (0.5 ** (epoch / max(1, epochs - 1) * 3))
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def training_windows(n: int = 2400, seed: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented prose as (classes, labels), with labelled spans and with numbers that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))

    def word() -> str:
        w = "".join(rng.choice("aeiounrstlmdpégü") for _ in range(rng.randint(2, 9)))
        return w.capitalize() if rng.random() < 0.12 else w

    def card() -> str:  # the check digit is not the network's to learn: what it finds must pass it afterwards
        number = str(rng.randint(3, 6)) + d(rng.choice([12, 14, 15, 15, 15, 18]))
        sep = rng.choice(["", "", " ", "-", "/", ".", "  ", " - "])
        return sep.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        sep = rng.choice([" ", " ", "-", "-", ".", " - "])
        head = rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) ", f"({d(3)}) ", f"0{d(2)}{sep}", f"+{rng.randint(1, 99)}{sep}", f"{d(3)}{sep}", f"{d(3)}{sep}", f"{d(3)}{sep}", f"00{d(2)} "])
        return head + rng.choice([f"{d(3)}{sep}{d(4)}", f"{d(4)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(2)}", f"{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}"])

    def email() -> str:
        at = rng.choice(["@", "@", "@", " @ ", "@ "])
        return f"{word()}{rng.choice(['.', '_', '', '-', '+'])}{rng.choice([word(), d(2), ''])}{at}{word()}.{rng.choice(['com', 'org', 'example.com', 'fr', 'co.uk', 'net'])}".replace("..", ".")

    def ip() -> str:
        return rng.choice([".", ".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def none() -> str:
        return rng.choice([
            lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", lambda: f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}",
            lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: d(rng.randint(1, 8)), lambda: "#" + d(rng.randint(4, 12)),
            lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}.{d(2)} EUR", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: d(rng.randint(9, 20)),
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        ])()

    ids, labels = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    makers = (email, ip, card, phone)
    for i in range(n):
        text, marks = "", []
        while len(text) < WINDOW + 30:
            r = rng.random()
            if r < 0.25:
                k = rng.randrange(4)
                piece = makers[k]()
                marks.append((len(text), len(text) + len(piece), k))
            elif r < 0.4:
                piece = none()
            else:
                piece = word()
            text += piece + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", ": ", ".\n"])
        cut = rng.randint(0, 30)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)[cut : cut + WINDOW]
        ids[i, : len(codes)] = char_classes(codes)
        for a, b, k in marks:
            for j in range(max(a, cut), min(b, cut + WINDOW)):
                labels[i, j - cut] = 1 + 2 * k + (j > a)
    return ids, labels


@lru_cache(maxsize=1)
def fit(windows: int = 3200, epochs: int = 8) -> Net:
    net = Net()
    net.train(*training_windows(windows), epochs=epochs)
    return net


# --- decoding -----------------------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of text around digits and @ signs, with a margin, in order and disjoint."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _well_formed(kind: int, s: str) -> bool:
    digits = _digits(s)
    if kind == 0:
        return re.fullmatch(r"[^\s@]{1,64}\s?@\s?[^\s@.]+(?:\.[^\s@.]+)+", s) is not None
    if kind == 1:
        parts = re.fullmatch(r"(\d{1,3})\s?\.\s?(\d{1,3})\s?\.\s?(\d{1,3})\s?\.\s?(\d{1,3})", s)
        return parts is not None and all(int(x) <= 255 for x in parts.groups())
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", s) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"[0-9(][0-9 ().-]*[ ().-][0-9 ().-]*[0-9]", s) is not None and 9 <= len(digits) <= 15 and re.fullmatch(r"[0-9]+(\.[0-9]+){2,3}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}.*", s) is None


def added_spans(net: Net, texts: list[str], base: list[list[Span]], sure: float = 0.5, batch: int = 256) -> list[list[Span]]:
    """For each text the network's spans beside its base spans.  Regions that base spans explain are not read."""
    windows, owner = [], []  # owner: (region, offset of the window in it)
    spots: list[tuple[int, int, np.ndarray]] = []
    for k, text in enumerate(texts):
        for a, b in regions(text):
            rest = list(text[a:b])
            for s, _, e in base[k]:
                for j in range(max(s, a), min(e, b)):
                    rest[j - a] = "x"
            if not _GATE.search("".join(rest)):
                continue
            classes = char_classes(np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32))
            for at in range(0, max(1, len(classes) - WINDOW + STRIDE), STRIDE):
                part = classes[at : at + WINDOW]
                windows.append(np.pad(part, (0, WINDOW - len(part))))
                owner.append((len(spots), at))
            spots.append((k, a, classes))
    total = [np.zeros((len(c), LABELS)) for _, _, c in spots]
    weight = [np.zeros((len(c), 1)) for _, _, c in spots]
    edge = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0)[:, None]
    for i in range(0, len(windows), batch):
        scores = net.forward(np.stack(windows[i : i + batch]))
        for j, (r, at) in enumerate(owner[i : i + batch]):
            n = min(WINDOW, len(total[r]) - at)
            total[r][at : at + n] += scores[:n, j] * edge[:n]
            weight[r][at : at + n] += edge[:n]
    out: list[list[Span]] = [[] for _ in texts]
    trans, start = net.p["trans"], net.p["start"]
    for (k, a, _), t, w in zip(spots, total, weight):
        scores = t / w
        path = viterbi(scores, trans, start)
        post = None
        at = 0
        while at < len(path):
            if path[at] == 0:
                at += 1
                continue
            kind, end = (path[at] - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 * kind + 2:
                end += 1
            s = texts[k][a + at : a + end].rstrip(" .,;:\n")
            span = (a + at, kind, a + at + len(s))
            if s and _well_formed(kind, s) and not any(x[0] < span[2] and span[0] < x[2] for x in base[k]):
                if post is None:
                    post = marginals(scores[:, None, :], np.array([len(scores)]), trans, start)[0][:, 0]
                around = texts[k][max(0, span[0] - 1) : span[0]] + texts[k][span[2] : span[2] + 1]
                if post[np.arange(at, at + len(s)), path[at : at + len(s)]].mean() >= sure and not any(c.isalnum() for c in around):
                    out[k].append(span)
            at = end
    return out


def find_spans(docs: DataFrame, net: Net, step: int = 512) -> DataFrame:
    """doc_id, base, spans: both as arrays of (start, kind, end) by start, then kind; ``spans`` holds the base ones too."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(net)
    item = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) if _GATE.search(t) else [] for t in texts]
                more = added_spans(known.value, texts, base)
                cols = [[[dict(zip(("start", "kind", "end"), s)) for s in x] for x in rows] for rows in (base, [sorted(b + m) for b, m in zip(base, more)])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, item) for c in cols)], names=["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    array = "array<struct<start:int,kind:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {array}, spans {array}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_spans(table(spark, sf_dir, "documents"), fit())
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
