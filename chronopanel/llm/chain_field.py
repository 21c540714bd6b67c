"""Linear-chain conditional random field with two states, bad and good, over the lines of many documents at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChainField:
    """good: weights, of the line itself, the line before and the line after, and one constant; moves: score of each pair of states."""

    good: np.ndarray
    moves: np.ndarray

    @staticmethod
    def empty(n_features: int) -> ChainField:
        return ChainField(np.zeros(3 * n_features + 1), np.zeros((2, 2)))


def neighbours(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have one before and one after in the same document."""
    n = int(firsts[-1])
    before, after = np.ones(n, bool), np.ones(n, bool)
    full = np.diff(firsts) > 0
    before[firsts[:-1][full]] = False
    after[firsts[1:][full] - 1] = False
    return before, after


def emissions(field: ChainField, lines: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How much better the state good suits each line than bad."""
    k = lines.shape[1]
    before, after = neighbours(firsts)
    out = lines @ field.good[:k] + field.good[-1]
    if len(lines) > 1:
        out[1:] += np.where(before[1:], lines[:-1] @ field.good[k : 2 * k], 0)
        out[:-1] += np.where(after[:-1], lines[1:] @ field.good[2 * k : 3 * k], 0)
    return out


def _steps(firsts: np.ndarray) -> list[np.ndarray]:
    """The lines at place 0, 1, 2, ... of all documents that are as long."""
    counts = np.diff(firsts)
    order = np.argsort(-counts, kind="stable")
    begin, counts = firsts[:-1][order], counts[order]
    live = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right")
    return [begin[:m] + t for t, m in enumerate(live.tolist())]


def forward_backward(field: ChainField, good: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-space alpha and beta (lines x states), and log Z at each line, from the emissions."""
    n = len(good)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[:, 1] = good
    steps, t = _steps(firsts), field.moves
    for now in steps[1:]:
        was = alpha[now - 1]
        alpha[now, 0] = np.logaddexp(was[:, 0] + t[0, 0], was[:, 1] + t[1, 0])
        alpha[now, 1] = good[now] + np.logaddexp(was[:, 0] + t[0, 1], was[:, 1] + t[1, 1])
    for now in steps[:0:-1]:
        bad, fine = beta[now, 0], good[now] + beta[now, 1]
        beta[now - 1, 0] = np.logaddexp(t[0, 0] + bad, t[0, 1] + fine)
        beta[now - 1, 1] = np.logaddexp(t[1, 0] + bad, t[1, 1] + fine)
    total = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    return alpha, beta, total


def good_marginals(field: ChainField, lines: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Probability of the state good of each line, given its whole document."""
    alpha, beta, total = forward_backward(field, emissions(field, lines, firsts), firsts)
    return np.exp(alpha[:, 1] + beta[:, 1] - total)


def fit(lines: np.ndarray, firsts: np.ndarray, states: np.ndarray, weights: np.ndarray, field: ChainField | None = None, steps: int = 250, rate: float = 0.05, penalty: float = 1e-3) -> ChainField:
    """Maximise the weighted log-likelihood of the states by full-batch adaptive gradient steps. weights: one for each document."""
    k = lines.shape[1]
    field = field or ChainField.empty(k)
    before, after = neighbours(firsts)
    weight = np.repeat(weights, np.diff(firsts))
    pairs = np.flatnonzero(before)
    theta = np.concatenate([field.good, field.moves.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, float(weights.sum()))
    for step in range(1, steps + 1):
        field = ChainField(theta[: 3 * k + 1], theta[3 * k + 1 :].reshape(2, 2))
        good = emissions(field, lines, firsts)
        alpha, beta, total = forward_backward(field, good, firsts)
        miss = (states - np.exp(alpha[:, 1] + beta[:, 1] - total)) * weight
        gradient = np.zeros_like(theta)
        gradient[:k] = miss @ lines
        gradient[k : 2 * k] = miss[1:][before[1:]] @ lines[:-1][before[1:]]
        gradient[2 * k : 3 * k] = miss[:-1][after[:-1]] @ lines[1:][after[:-1]]
        gradient[3 * k] = miss.sum()
        for i in (0, 1):
            for j in (0, 1):
                expected = np.exp(alpha[pairs - 1, i] + field.moves[i, j] + good[pairs] * j + beta[pairs, j] - total[pairs])
                seen = (states[pairs - 1] == i) & (states[pairs] == j)
                gradient[3 * k + 1 + 2 * i + j] = ((seen - expected) * weight[pairs]).sum()
        gradient = gradient / scale - penalty * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ChainField(theta[: 3 * k + 1], theta[3 * k + 1 :].reshape(2, 2))
