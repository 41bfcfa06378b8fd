"""Linear-chain conditional random fields over rows of many short chains, vectorised over the chains."""

from __future__ import annotations

import numpy as np


class Chains:
    """Chains of items laid end to end, walked in lockstep: at step t all chains longer than t move together."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        starts = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=starts[1:])
        self.starts = starts[:-1][self.order]
        self.steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(1, self.steps + 1), side="right")

    def at(self, t: int) -> np.ndarray:
        """Item numbers of step t."""
        return self.starts[: self.active[t]] + t


def viterbi(emit: np.ndarray, move: np.ndarray, chains: Chains) -> np.ndarray:
    """Best label of every item; of equally good ones the smaller label. emit: items x labels, move: labels x labels."""
    best, back = emit.copy(), np.zeros(emit.shape, np.int8)
    for t in range(1, chains.steps):
        now, before = chains.at(t), chains.at(t - 1)[: chains.active[t]]
        reach = best[before][:, :, None] + move
        back[now] = reach.argmax(1)
        best[now] += reach.max(1)
    label = np.zeros(len(emit), np.int8)
    ends = chains.starts + chains.lengths - 1
    some = chains.lengths > 0
    label[ends[some]] = best[ends[some]].argmax(1)
    for t in range(chains.steps - 1, 0, -1):
        now, before = chains.at(t), chains.at(t - 1)[: chains.active[t]]
        label[before] = back[now, label[now]]
    return label


def marginals(emit: np.ndarray, move: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: label probabilities of every item, and the expected number of each transition."""
    fore, after = emit.copy(), np.zeros_like(emit)
    for t in range(1, chains.steps):
        now, before = chains.at(t), chains.at(t - 1)[: chains.active[t]]
        fore[now] += np.logaddexp.reduce(fore[before][:, :, None] + move, axis=1)
    pairs = np.zeros_like(move)
    for t in range(chains.steps - 1, 0, -1):
        now, before = chains.at(t), chains.at(t - 1)[: chains.active[t]]
        right = emit[now] + after[now]
        after[before] = np.logaddexp.reduce(move + right[:, None, :], axis=2)
        both = fore[before][:, :, None] + move + right[:, None, :]
        pairs += np.exp(both - np.logaddexp.reduce(both.reshape(len(now), -1), axis=1)[:, None, None]).sum(0)
    joint = fore + after
    return np.exp(joint - np.logaddexp.reduce(joint, axis=1, keepdims=True)), pairs


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int = 2, rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and moves that maximise the chains' conditional likelihood, by Adam on all of them."""
    chains = Chains(lengths)
    w, move = np.zeros((features.shape[1], n_labels)), np.zeros((n_labels, n_labels))
    if not len(features):
        return w, move
    seen = np.zeros_like(w)
    for k in range(n_labels):
        seen[:, k] = features[labels == k].sum(0)
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    moved = np.zeros_like(move)
    np.add.at(moved, (labels[at], labels[at + 1]), 1)
    state = [np.zeros_like(x) for x in (w, w, move, move)]
    for step in range(1, rounds + 1):
        p, pairs = marginals(features @ w, move, chains)
        grads = ((seen - features.T @ p) / len(labels) - l2 * w, (moved - pairs) / len(labels) - l2 * move)
        for x, g, m, v in ((w, grads[0], state[0], state[1]), (move, grads[1], state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, move
