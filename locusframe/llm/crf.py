"""A linear-chain conditional random field in numpy: marginals by forward-backward, training by Adam.

It runs inside Spark's tasks (marginals of a batch of texts) and on bounded samples (training).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps between two scalings to a sum of 1; each step's largest factors are 1, so little is lost in between.
RESCALE = 8


@dataclass
class Bags:
    """Rows as bags of feature numbers: the design matrix of binary features. Each row has one at least."""

    features: np.ndarray
    starts: np.ndarray
    n_features: int

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.features], self.starts, axis=0)

    def tdot(self, rows: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.r_[self.starts, len(self.features)])
        spread = np.repeat(rows, sizes, axis=0)
        return np.stack([np.bincount(self.features, spread[:, k], self.n_features) for k in range(rows.shape[1])], axis=1)


@dataclass
class Dense:
    """Rows as numbers."""

    values: np.ndarray

    @property
    def n_features(self) -> int:
        return self.values.shape[1]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self.values @ weights

    def tdot(self, rows: np.ndarray) -> np.ndarray:
        return self.values.T @ rows


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Label marginals for the rows of ``scores`` (sequences one after another, as long as ``lengths`` says).

    ``moves`` are the log weights of transitions. ``expected``, if given, gets the expected transition counts added.
    All sequences go forward and backward together, the longest first: at step t the first ones are those that last so
    long. Rows are held by step, without padding.
    """
    out = np.empty_like(scores)
    longest = int(lengths.max(initial=0))
    if not longest:
        return out
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = len(order) - np.searchsorted(lengths[order][::-1], np.arange(longest), side="right")
    first = np.cumsum(active) - active
    starts = np.cumsum(lengths) - lengths
    step_of = np.arange(len(scores)) - np.repeat(starts, lengths)
    at = first[step_of] + np.repeat(rank, lengths)
    emit = np.empty_like(scores, float)
    emit[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    one = np.ones(scores.shape[1])
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    bounds = [*first.tolist(), len(emit)]
    a = forward[: bounds[1]] = emit[: bounds[1]]
    for t in range(1, longest):
        i, j = bounds[t], bounds[t + 1]
        a = (a[: j - i] @ step) * emit[i:j]
        if not t % RESCALE:
            a /= (a @ one)[:, None]
        forward[i:j] = a
    b = backward[bounds[-2] :]
    for t in range(longest - 2, -1, -1):
        i, j, k = bounds[t], bounds[t + 1], bounds[t + 2]
        b = (emit[j:k] * b) @ step.T
        if not t % RESCALE:
            b /= (b @ one)[:, None]
        backward[i : i + k - j] = b
        b = backward[i:j]
    both = forward * backward
    out[:] = (both / (both @ one)[:, None])[at]
    if expected is not None:
        now = np.flatnonzero(step_of + 1 < np.repeat(lengths, lengths))
        before, ahead = forward[at[now]], (emit * backward)[at[now + 1]]
        whole = ((before @ step) * ahead) @ one
        expected += ((before / whole[:, None]).T @ ahead) * step
    return out


def fit(
    design: Bags | Dense, rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int, rounds: int, rate: float, l2: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weights [features, labels] and transition weights, by Adam on the whole sample's log-likelihood.

    ``rows`` holds, for each position of all sequences, its row in ``design`` (so equal words share one row).
    """
    weights, moves = np.zeros((design.n_features, n_labels)), np.zeros((n_labels, n_labels))
    inner = np.ones(len(labels), bool)
    ends = np.cumsum(lengths)
    inner[ends[lengths > 0] - 1] = False
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (labels[:-1][inner[:-1]], labels[1:][inner[:-1]]), 1)
    hot = np.eye(n_labels)[labels]
    n = len(labels)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, moves)]
    for turn in range(1, rounds + 1):
        expected = np.zeros_like(moves)
        gap = hot - marginals(design.dot(weights)[rows], lengths, moves, expected)
        per_row = np.stack([np.bincount(rows, gap[:, k], len(design.starts) if isinstance(design, Bags) else len(design.values)) for k in range(n_labels)], axis=1)
        grads = (design.tdot(per_row) / n - l2 * weights, (seen - expected) / n - l2 * moves)
        for p, g, (m, v) in zip((weights, moves), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return weights, moves
