"""Linear-chain conditional random field over indicator features, in numpy.

Positions stand in sequences given by ``cut`` (borders). Position i shows unit ``which[i]``;
unit u has the feature ids ``index[ptr[u]:ptr[u + 1]]``. Work goes step by step over all
sequences at once, longest first, so Python's share is the longest sequence, not all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Learned weights: features x labels, transitions, first label."""

    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def scores(weight: np.ndarray, index: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the weights of each unit's features; units without features score 0."""
    n = len(ptr) - 1
    out = np.zeros((n, weight.shape[1]), np.float64)
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        out[some] = np.add.reduceat(weight[index], ptr[some], axis=0)
    return out


def _steps(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each non-empty sequence, longest first, and how many are longer than each step."""
    length = np.diff(cut)
    order = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
    active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
    return cut[:-1][order], active


def forward_backward(emit: np.ndarray, cut: np.ndarray, chain: Chain) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Marginals of every position, log partition of all sequences, expected transitions, expected first labels."""
    n, k = emit.shape
    first, active = _steps(cut)
    top = emit.max(axis=1, keepdims=True) if n else np.zeros((0, 1))
    e, move = np.exp(emit - top), np.exp(chain.trans)
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.ones(n)
    a = np.tile(np.exp(chain.start), (len(first), 1))
    for t, m in enumerate(active.tolist()):
        at = first[:m] + t
        a = (a[:m] @ move if t else a) * e[at]
        s = a.sum(axis=1)
        a /= s[:, None]
        alpha[at], scale[at] = a, s
    for t in range(len(active) - 2, -1, -1):
        nxt = first[:active[t + 1]] + t + 1
        beta[nxt - 1] = (e[nxt] * beta[nxt] / scale[nxt, None]) @ move.T
    inner = np.ones(n, bool)
    inner[cut[:-1][np.diff(cut) > 0]] = False
    nxt = np.flatnonzero(inner)
    pairs = move * (alpha[nxt - 1].T @ (e[nxt] * beta[nxt] / scale[nxt, None]))
    marginal = alpha * beta
    return marginal, float(np.log(scale).sum() + top.sum()), pairs, marginal[first].sum(axis=0)


def viterbi(emit: np.ndarray, cut: np.ndarray, chain: Chain) -> np.ndarray:
    """Best label of every position; ties go to the smaller label."""
    n, k = emit.shape
    first, active = _steps(cut)
    back, label = np.zeros((n, k), np.int32), np.zeros(n, np.int64)
    best = np.empty((n, k))
    for t, m in enumerate(active.tolist()):
        at = first[:m] + t
        if t:
            through = best[at - 1][:, :, None] + chain.trans
            back[at] = through.argmax(axis=1)
            best[at] = through.max(axis=1) + emit[at]
        else:
            best[at] = chain.start + emit[at]
    for t in range(len(active) - 1, -1, -1):
        at = first[:active[t]] + t
        go_on = active[t + 1] if t + 1 < len(active) else 0
        label[at[go_on:]] = best[at[go_on:]].argmax(axis=1)
        if go_on:
            label[at[:go_on]] = back[at[:go_on] + 1, label[at[:go_on] + 1]]
    return label


def fit(index: np.ndarray, ptr: np.ndarray, which: np.ndarray, gold: np.ndarray, cut: np.ndarray, features: int, labels: int,
        rounds: int = 60, rate: float = 0.2, ridge: float = 1e-4) -> Chain:
    """Weights of largest penalised likelihood, by full-batch gradient steps of adaptive size."""
    shape = [(features, labels), (labels, labels), (labels,)]
    value = [np.zeros(s) for s in shape]
    first_moment, second_moment = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
    inner = np.ones(len(gold), bool)
    head = cut[:-1][np.diff(cut) > 0]
    inner[head] = False
    nxt = np.flatnonzero(inner)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[nxt - 1], gold[nxt]), 1)
    begun = np.bincount(gold[head], minlength=labels).astype(float)
    unit = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    for step in range(1, rounds + 1):
        chain = Chain(*value)
        marginal, _, pairs, starts = forward_backward(scores(chain.weight, index, ptr)[which], cut, chain)
        miss = -marginal
        miss[np.arange(len(gold)), gold] += 1
        by_unit = np.stack([np.bincount(which, miss[:, k], len(ptr) - 1) for k in range(labels)], axis=1)
        grad = [
            np.stack([np.bincount(index, by_unit[unit, k], features) for k in range(labels)], axis=1),
            seen - pairs,
            begun - starts,
        ]
        for p, g, m, v in zip(value, grad, first_moment, second_moment, strict=True):
            g = g / max(len(gold), 1) - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(*(p.astype(np.float64) for p in value))
