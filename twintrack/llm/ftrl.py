"""Follow-the-regularised-leader (proximal) logistic regression on sparse rows, binary or multinomial, with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``size`` features by ``classes`` outputs (1: logistic, more: softmax). ``l1`` gives zeros, ``l2`` shrinks."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One update from a row with distinct features ``at``, values ``x`` and class ``y``."""
        w = self.weights(at)
        p = probabilities(x @ w)
        p[y if p.size > 1 else 0] -= 1 if p.size > 1 else y
        g = x[:, None] * p[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int, seed: int = 0) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                self.step(*rows[k], labels[k])
        return self


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Sigmoid of a single output, softmax (last axis) of several."""
    if logits.shape[-1] == 1:
        return 0.5 * (1 + np.tanh(0.5 * logits))
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in 0.05 to 20 with the least negative log-likelihood of held-back rows; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = probabilities(logits / t)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).sum())

    grid = np.geomspace(0.05, 20, 121)
    return float(min(grid, key=loss))
