"""Linear-chain conditional random fields in numpy: scaled forward-backward over padded batches, Viterbi, gradients."""

from __future__ import annotations

import numpy as np


def _forward(e: np.ndarray, keep: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, labels = e.shape
    alpha, norm = np.empty_like(e), np.ones((steps, rows))
    a = e[0] * start
    for t in range(steps):
        if t:
            b = (a @ trans) * e[t]
            a = b if keep[t].all() else np.where(keep[t][:, None], b, a)
        z = a.sum(axis=1)
        a = a / z[:, None]
        alpha[t], norm[t] = a, np.where(keep[t], z, 1.0)
    return alpha, norm


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, want_pairs: bool = False):
    """Posteriors of labels by forward-backward.

    scores: (steps, rows, labels) log emission scores, padded; trans, start: log transition and start scores.
    Returns (steps, rows, labels) posteriors (zero where padded), log partition per row and, if asked for, the expected
    number of transitions of each pair of labels over all rows.
    """
    steps, rows, labels = scores.shape
    keep = np.arange(steps)[:, None] < lengths[None, :]
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    t, s = np.exp(trans), np.exp(start)
    alpha, norm = _forward(e, keep, t, s)
    beta = np.ones((rows, labels))
    post, pairs = np.empty_like(alpha), np.zeros((labels, labels))
    for i in range(steps - 1, -1, -1):
        p = alpha[i] * beta
        post[i] = p / p.sum(axis=1, keepdims=True)
        if i:
            eb = e[i] * beta
            if want_pairs:
                k = keep[i]
                joint = alpha[i - 1][k][:, :, None] * t[None] * eb[k][:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = eb @ t.T
            back = back / back.sum(axis=1, keepdims=True)
            beta = back if keep[i].all() else np.where(keep[i][:, None], back, 1.0)
    post *= keep[:, :, None]
    logz = np.log(norm).sum(axis=0) + (top[:, :, 0] * keep).sum(axis=0)
    return post, logz, pairs


def flat_marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, segment: int = 64) -> np.ndarray:
    """Posteriors of the steps of many sequences laid end to end: exactly those of ``marginals``, whatever the lengths.

    scores: (all steps, labels); lengths: steps of each sequence.  Sequences are cut into segments that are read in
    step.  A segment's matrix says what leaves it for each label that enters; messages then pass over the matrices of a
    sequence both ways, and a last pass forward and back inside all segments gives every step's posterior.
    """
    labels, lengths = scores.shape[1], lengths.astype(np.int64)
    e, t = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf)), np.exp(trans)
    parts = -(-lengths // segment)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(segment, lengths[owner] - nth * segment)
    order = np.argsort(-size, kind="stable")  # longest first: the segments that have a step s are the first ones
    first, size = (np.cumsum(lengths) - lengths)[owner] + nth * segment, size[order]
    first = first[order]
    alive = [int(np.searchsorted(-size, -s, side="left")) for s in range(segment)]  # segments of more than s steps
    steps = segment if len(size) == 0 else int(size.max(initial=0))

    through = np.zeros((len(size), labels, labels))
    through[:, range(labels), range(labels)] = e[first] if len(size) else 0
    for s in range(1, steps):
        n = alive[s]
        m = (through[:n].reshape(-1, labels) @ t).reshape(n, labels, labels) * e[first[:n] + s][:, None, :]
        through[:n] = m / m.max(axis=(1, 2), keepdims=True) if s % 8 == 0 else m
    enters, leaves = np.empty((len(size), labels)), np.empty((len(size), labels))
    at = np.empty(len(size), np.int64)
    at[order] = np.arange(len(size))  # place of a segment in the sorted arrays
    head = np.cumsum(parts) - parts
    by_parts = np.argsort(-parts, kind="stable")
    forward, back = np.tile(np.exp(start), (len(parts), 1)), np.ones((len(parts), labels))
    for r in range(int(parts.max(initial=0))):
        who = by_parts[: int(np.searchsorted(-parts[by_parts], -r, side="left"))]
        a, b = at[head[who] + r], at[head[who] + parts[who] - 1 - r]
        enters[a], leaves[b] = forward[who], back[who]
        m = np.einsum("di,dij->dj", forward[who], through[a]) @ t
        forward[who] = m / m.max(axis=1, keepdims=True)
        m = np.einsum("dij,dj->di", through[b], back[who]) @ t.T
        back[who] = m / m.max(axis=1, keepdims=True)

    post = np.empty_like(e)
    alpha = np.empty((steps, len(size), labels))
    for s in range(steps):
        n = alive[s]
        m = (enters if s == 0 else alpha[s - 1, :n] @ t) * e[first[:n] + s]
        alpha[s, :n] = m / m.max(axis=1, keepdims=True) if s % 8 == 0 else m
    beta = leaves
    for s in range(steps - 1, -1, -1):
        n = alive[s]
        p = alpha[s, :n] * beta[:n]
        post[first[:n] + s] = p / p.sum(axis=1, keepdims=True)
        m = (e[first[:n] + s] * beta[:n]) @ t.T
        beta[:n] = m / m.max(axis=1, keepdims=True) if s % 8 == 0 else m
    return post


def viterbi(scores: np.ndarray, trans: np.ndarray, start: np.ndarray) -> list[int]:
    """The best labels of one sequence (steps, labels)."""
    best, back = scores[0] + start, []
    for row in scores[1:]:
        step = best[:, None] + trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Adagrad:
    def __init__(self, shape, rate: float):
        self.sum, self.rate = np.full(shape, 1e-6), rate

    def step(self, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        self.sum[at] += grad * grad
        value[at] -= self.rate * grad / np.sqrt(self.sum[at])


def fit_sparse(seqs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_features: int, n_labels: int, epochs: int = 3, batch: int = 32, rate: float = 0.2, decay: float = 1e-6, seed: int = 3):
    """Weights of a chain with sparse binary features by stochastic gradients of the log likelihood.

    seqs: (features, offsets, labels) per sequence; the features of step i are ``features[offsets[i]:offsets[i+1]]``.
    Returns emission weights (n_features, n_labels), transitions and start scores.
    """
    rng = np.random.default_rng(seed)
    w, trans, start = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    ow, ot, os_ = Adagrad(w.shape, rate), Adagrad(trans.shape, rate), Adagrad(start.shape, rate)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for b in range(0, len(order), batch):
            part = [seqs[i] for i in order[b : b + batch]]
            lengths = np.array([len(s[2]) for s in part])
            feats = np.concatenate([s[0] for s in part])
            counts = np.concatenate([np.diff(s[1]) for s in part])
            step_of = np.repeat(np.arange(len(counts)), counts)
            flat = np.zeros((len(counts), n_labels))
            for y in range(n_labels):
                flat[:, y] = np.bincount(step_of, weights=w[feats, y], minlength=len(counts))
            scores = np.zeros((lengths.max(), len(part), n_labels))
            rows = np.repeat(np.arange(len(part)), lengths)
            cols = np.concatenate([np.arange(n) for n in lengths])
            scores[cols, rows] = flat
            post, _, pairs = marginals(scores, lengths, trans, start, want_pairs=True)
            gold = np.concatenate([s[2] for s in part])
            g = post[cols, rows]
            g[np.arange(len(gold)), gold] -= 1
            used, place = np.unique(feats, return_inverse=True)
            gw = np.stack([np.bincount(place, weights=g[step_of, y], minlength=len(used)) for y in range(n_labels)], axis=1)
            ow.step(w, gw / len(part) + decay * w[used], used)
            seen = np.zeros_like(trans)
            for s in part:
                np.add.at(seen, (s[2][:-1], s[2][1:]), 1)
            ot.step(trans, (pairs - seen) / len(part))
            g0 = post[0].sum(axis=0)
            np.subtract.at(g0, [int(s[2][0]) for s in part], 1)
            os_.step(start, g0 / len(part))
    return w, trans, start
