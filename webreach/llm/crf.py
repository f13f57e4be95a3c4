"""Linear-chain conditional random field over indicator features: fitted on the
driver from a small labelled sample, decoded by Viterbi in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    emit: np.ndarray    # (features, labels)
    step: np.ndarray    # (labels, labels), from row to column
    first: np.ndarray   # (labels,)


def zero(n_features: int, n_labels: int) -> Crf:
    return Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))


def scores(crf: Crf, features: np.ndarray) -> np.ndarray:
    """(items, slots) feature numbers -> (items, labels)."""
    out = np.zeros((len(features), crf.emit.shape[1]), np.float32)
    emit = crf.emit.astype(np.float32)
    for slot in features.T:
        out += emit[slot]
    return out


def viterbi(crf: Crf, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each item; sequences of ``lengths`` items follow each
    other in ``score``. All sequences take their t-th step together. Of equal
    paths, the one with the smaller labels from the end on is taken."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int8)
    lengths = lengths[lengths > 0]
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, size = start[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
    back = np.zeros((n, k), np.int8)
    step, delta = crf.step.astype(np.float32), score[start] + crf.first.astype(np.float32)
    ends = delta.copy()
    for t in range(1, size[0]):
        m = active[t]
        paths = delta[:m, :, None] + step
        back[start[:m] + t] = paths.argmax(1)
        delta = paths.max(1) + score[start[:m] + t]
        ends[:m] = delta
    out = np.zeros(n, np.int8)
    label = ends.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return out


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int,
        weights: np.ndarray | None = None, rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam. ``weights``: of each sequence."""
    lengths = np.asarray(lengths)
    if not len(features):
        return zero(n_features, n_labels)
    b, t, k = len(lengths), int(lengths.max()), n_labels
    start = np.cumsum(lengths) - lengths
    inside = np.arange(t) < lengths[:, None]
    item = np.where(inside, start[:, None] + np.arange(t), 0)
    w = np.ones(b) if weights is None else weights
    total = (w * lengths).sum()
    gold = np.zeros((len(features), k))
    gold[np.arange(len(features)), labels] = np.repeat(w, lengths)
    follows = np.ones(len(features), bool)
    follows[start] = False
    pairs = np.zeros((k, k))
    at = np.flatnonzero(follows)
    np.add.at(pairs, (labels[at - 1], labels[at]), np.repeat(w, lengths)[at])
    firsts = np.bincount(labels[start], w, k)
    params = [np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        emit, step, first = params
        s = sum(emit[slot] for slot in features.T)[item]
        alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
        alpha[:, 0] = s[:, 0] + first
        for i in range(1, t):
            x = alpha[:, i - 1, :, None] + step
            top = x.max(1)
            alpha[:, i] = np.where(inside[:, i, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + s[:, i], alpha[:, i - 1])
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        expected = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            x = step + (s[:, i + 1] + beta[:, i + 1])[:, None, :]
            top = x.max(2)
            beta[:, i] = np.where(inside[:, i + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
            p = np.exp(alpha[:, i, :, None] + x - z[:, None, None])
            expected += (p * (w * inside[:, i + 1])[:, None, None]).sum(0)
        own = np.exp(alpha + beta - z[:, None, None]) * w[:, None, None]
        diff = gold - own[inside]
        grads = [np.zeros_like(emit), pairs - expected, firsts - own[:, 0].sum(0)]
        for slot in features.T:
            for j in range(k):
                grads[0][:, j] += np.bincount(slot, diff[:, j], n_features)
        for p, g, m, v in zip(params, grads, moment, square, strict=True):
            g = -g / total + l2 * p / len(features) ** 0.5
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-9)
    return Crf(*params)
